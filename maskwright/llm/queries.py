"""Registered queries of the pipeline operators, with expected results as SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, conversations
from .contamination import contamination
from .gated_model import score_documents
from .jaccard_join import jaccard_join
from .line_dedup import drop_lines
from .near_duplicates import near_duplicates
from .perspectives import perspectives
from .pieces import encode_samples
from .quality import quality
from .repeats import remove_repeats
from .token_files import encode_to_files, read_back
from .warc import read_archives, write_archives


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) u(i)
), frequent AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, f.key IS NOT NULL AND l.doc_id <> f.holder AS gone
  FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.expr("array_join(transform(masks, x -> concat(x.start, '-', x.stop)), ',')")
    return perspectives(_read(spark, sf_dir, "conversations")).withColumn("masks", masks)


PERSPECTIVES_SQL = r"""
WITH t AS (
  SELECT conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') AS name, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nr FROM conversations
), views AS (
  SELECT t.*, p.participant, nr // 64 AS part, t.name = participant AS mine,
         '<|' || CASE WHEN t.name = 'system' THEN t.name WHEN t.name = participant THEN 'assistant' ELSE 'user:' || t.name END
         || '|>' || chr(10) AS head
  FROM t JOIN (SELECT DISTINCT conv_id, name AS participant FROM t WHERE name <> 'system') p ON t.conv_id = p.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY nr) AS stop FROM views
)
SELECT conv_id, participant, part, count(*) AS n_messages, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY nr) AS text,
       coalesce(string_agg((stop - 8 - length(text))::BIGINT::VARCHAR || '-' || (stop - 1)::BIGINT::VARCHAR, ',' ORDER BY nr) FILTER (mine), '') AS masks
FROM placed GROUP BY conv_id, participant, part
"""


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), k=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(_read(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
  FROM d, unnest(range(1, len(w) - least(len(w), 3) + 2)) u(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least_ AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least_ USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, files = encode_to_files(
        _read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_back(documents, files)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, unnest(range(0, len(h) // 2 - 99)) u(p)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM windows
), hits AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS head FROM ranked WHERE again
), islands AS (
  SELECT doc_id, p, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hits
), spans AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM islands GROUP BY ALL
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), found AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join("item_ids", ",").cast("binary")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(w) - n + 2)) u(i)
), hits AS (
  SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) u(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(_read(spark, sf_dir, "conversations"))


def _crc32(text: str) -> str:
    """SQL: crc32 of an ASCII text, four bits at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]

    def step(value: str) -> str:
        return f"xor(({value}) >> 4, ({table})[(({value}) & 15) + 1])"

    folded = (f"list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
              f"lambda c, b: {step(step('xor(c, b)'))}, 4294967295::BIGINT)")
    return f"xor({folded}, 4294967295)"


def _repair_steps() -> str:
    """SQL values (p, edit, initial, q, cost, audit): inserts, then one edit of a row, from state p to q."""
    rows = []
    for p in conversations.NEXT:
        state, cost, audit = p, 0, ""
        for _ in range(3):  # more inserts only come back to a state
            rows.append((p, "D", "", state, cost + 3, audit + "D"))
            for initial, after in conversations.NEXT[state].items():
                rows.append((p, "K", initial, after, cost, audit + "K"))
                if initial != "s":
                    rows.append((p, "R", "", after, cost + 2, audit + "R"))
            state, cost, audit = 3 if state == 2 else 2, cost + 2, audit + "I"
    return ", ".join(map(str, rows))


CONVERSATION_REPAIR_SQL = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) u(copy) WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nr,
         rtrim(text, E' 	

') AS ending, substr(role, 1, 1) AS initial FROM damaged
), facts AS (
  SELECT *, CASE WHEN ending = '' THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'd'
                 WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY nr) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM numbered
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM facts GROUP BY conv_id
), steps(p, edit, need, q, cost, audit) AS (
  VALUES {_repair_steps()}
), ways(conv_id, nr, q, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM counts
  UNION ALL
  SELECT w.conv_id, w.nr + 1, s.q, min(w.cost + s.cost + (s.edit <> 'D' AND fault = 't')::BIGINT),
         arg_min(w.audit || s.audit, {{'c': w.cost + s.cost + (s.edit <> 'D' AND fault = 't')::BIGINT, 'a': w.audit || s.audit}})
  FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.nr = w.nr
  JOIN steps s ON s.p = w.q AND (s.edit = 'D' OR fault IN ('k', 't') AND (s.edit = 'R' OR s.need = f.initial))
  GROUP BY w.conv_id, w.nr + 1, s.q
), ended AS (
  SELECT w.conv_id, min({{'c': w.cost + e.cost, 'a': w.audit || e.audit}}) AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.nr
  JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(q, cost, audit) ON e.q = w.q GROUP BY w.conv_id
), edits AS (
  SELECT conv_id, i, best.a[i] AS edit, length(replace(best.a[:i - 1], 'I', '')) AS nr, length(replace(best.a[:i], 'D', '')) AS place
  FROM ended, unnest(range(1, length(best.a) + 1)) u(i)
), kept AS (
  SELECT e.conv_id, i, edit, place, role, text,
         bool_or(place = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id)::INT AS system
  FROM edits e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.nr = e.nr AND edit <> 'I' WHERE edit <> 'D'
), rebuilt AS (
  SELECT conv_id, sha256(string_agg(
           CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || coalesce(text, ''), E'
' ORDER BY i)) AS sha FROM kept GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN rebuilt r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.with_label_errors(codebooks.compress(_read(spark, sf_dir, "embeddings")))


def _vector_codes_sql() -> str:
    parts, entries, rounds = codebooks.PARTS, codebooks.ENTRIES, codebooks.ROUNDS
    steps = [f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS y FROM v, unnest(range({parts})) u(part)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, y AS c FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""]
    for r in range(rounds + 1):
        steps.append(f""", a{r} AS (
  SELECT vec_id, p.part, any_value(y) AS y, min({{'d': list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c), 'e': e}}) AS best
  FROM p JOIN c{r} ON p.part = c{r}.part GROUP BY vec_id, p.part
)""")
        if r < rounds:
            steps.append(f""", m{r} AS (
  SELECT part, e, list(mean ORDER BY i) AS c FROM (
    SELECT part, best.e AS e, i, floor(sum(y[i]) / count(*)) AS mean FROM a{r}, unnest(range(1, len(y) + 1)) u(i) GROUP BY ALL) GROUP BY ALL
), c{r + 1} AS (
  SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.part = o.part AND m.e = o.e
)""")
    steps.append(f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), labels AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN v USING (vec_id) GROUP BY label
)
SELECT coded.*, label_error, (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, e, i))
                              FROM c{rounds}, unnest(range(1, len(c) + 1)) u(i)) AS codebooks_sha256
FROM coded JOIN v USING (vec_id) JOIN labels ON labels.label IS NOT DISTINCT FROM v.label
""")
    return "".join(steps)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"), shingle=5, percent=80)


JACCARD_JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) u(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_perspectives": op2_perspectives,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_language_model": op7_language_model,
    "op8_token_files": op8_token_files,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op2_perspectives": PERSPECTIVES_SQL,
    "op4_warc": WARC_SQL,
    "op6_near_duplicates": NEAR_DUPLICATES_SQL,
    "op9_repeated_passages": REPEATS_SQL,
    "op10_decontamination": DECONTAMINATION_SQL,
    "op11_conversation_repair": CONVERSATION_REPAIR_SQL,
    "op12_vector_codes": _vector_codes_sql(),
    "op13_jaccard_join": JACCARD_JOIN_SQL,
}
