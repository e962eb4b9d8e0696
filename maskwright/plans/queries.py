"""The registered queries: every operator over whole tables, with its expected
result as SQL where it can be stated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.detectors import CATEGORIES, bsn_valid, custom
from maskwright.functions.strategies import Strategy, decrypt, encrypt, get_strategy
from maskwright.functions.text import normalise
from maskwright.operators import decode as dec
from maskwright.operators import external as ext
from maskwright.operators import mapping as maps
from maskwright.operators import pages as pg
from maskwright.operators import reports as rep
from maskwright.operators import sealing
from maskwright.operators.detect import detect, detect_all, detect_raw
from maskwright.operators.resolve import resolve_spans
from maskwright.operators.rewrite import encode, encode_each, entries_table, kept_spans, prepare, replace_spans, sanitise
from maskwright.plans import corpora
from maskwright.operators.convert import convert
from maskwright.plans import oracle as o
from maskwright.session import deal, stage, staging_dir
from maskwright.sources import files
from maskwright.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _run_folder(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


SPAN_COLUMNS = ["doc_id", "start", "end", "text", "category", "confidence"]
MAPPING_COLUMNS = ["scope", "placeholder", "category", "num", "norm", "canonical", "variations", "occurrences"]


def flat_mapping(mapping: DataFrame) -> DataFrame:
    return mapping.withColumn("variations", F.array_join("variations", "|")).select(*MAPPING_COLUMNS)


# --- sources and pages -------------------------------------------------------

@query("source_documents", "select doc_id, length(text) as chars from documents")
def source_documents(spark, sf):
    return rep.text_sizes(files.read_documents(spark, f"{sf}/documents.parquet"))


_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_CHOSEN = o.PAGES + f""", chosen as materialized (select doc_id, page_no, coalesce(length({_TRIM('native_text')}) < 50 and ocr_text <> ''
  and length({_TRIM('ocr_text')}) > length({_TRIM('native_text')}), false) as from_ocr,
  case when from_ocr then ocr_text else native_text end as text from page_text)"""
_ASSEMBLED = (_CHOSEN + ", assembled as materialized (select doc_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || text, "
              "chr(10) || chr(10) order by page_no) as text from chosen group by doc_id)")


@query("pages_choose_text", f"with {_CHOSEN} select doc_id, page_no, from_ocr, text from chosen")
def pages_choose_text(spark, sf):
    return pg.choose_text(corpora.page_text(spark, sf)).select("doc_id", "page_no", "from_ocr", "text")


@query("pages_counts", f"with {_CHOSEN} select doc_id, count(*) as total_pages, count(*) filter (where not from_ocr) as native_pages, "
       "count(*) filter (where from_ocr) as ocr_pages from chosen group by doc_id")
def pages_counts(spark, sf):
    return pg.page_counts(pg.choose_text(corpora.page_text(spark, sf)))


@query("pages_assemble", f"with {_ASSEMBLED} select doc_id, text from assembled")
def pages_assemble(spark, sf):
    return pg.assemble(pg.choose_text(corpora.page_text(spark, sf)))


_PIECES = ("select doc_id, p, row_number() over (partition by doc_id order by nr) - 1 as nr from (select doc_id, nr, "
           + _TRIM("piece") + " as p from (select doc_id, unnest(regexp_split_to_array(text, '--- Page \\d+ ---')) as piece, "
           "generate_subscripts(regexp_split_to_array(text, '--- Page \\d+ ---'), 1) as nr from assembled)) where p <> ''")


@query("pages_split_parts", f"with {_ASSEMBLED} select doc_id, cast(nr // 2 + 1 as int) as part, string_agg(p, chr(10) || chr(10) order by nr) as text "
       f"from ({_PIECES}) group by doc_id, nr // 2")
def pages_split_parts(spark, sf):
    return pg.split_parts(pg.assemble(pg.choose_text(corpora.page_text(spark, sf))), max_pages=2)


@query("pages_slice_unmarked", "select doc_id, cast(i // 3 + 1 as int) as part, string_agg(substr(text, i * 1000 + 1, 1000), chr(10) || chr(10) order by i) as text "
       "from (select doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) as i from documents where length(text) > 0) group by doc_id, i // 3")
def pages_slice_unmarked(spark, sf):
    return pg.split_parts(corpora.documents(spark, sf), max_pages=3, size=1000)


@query("pages_chunk", """with recursive cuts as (
  select doc_id, text, 0 as chunk, 0 as start, 0 as stop from documents where length(text) > 0
  union all
  select doc_id, text, chunk + 1, stop, case
    when stop + 400 >= length(text) then length(text)
    when para > 200 then stop + para + 2 when sent > 200 then stop + sent + 2 else stop + 400 end
  from (select *, case when contains(piece, chr(10) || chr(10)) then 400 - strpos(reverse(piece), chr(10) || chr(10)) - 1 else -1 end as para,
    case when contains(piece, '. ') then 400 - strpos(reverse(piece), ' .') - 1 else -1 end as sent
    from (select *, substr(text, stop + 1, 400) as piece from cuts where stop < length(text))))
  select doc_id, cast(chunk - 1 as int) as chunk, cast(start as int) as start, cast(stop as int) as "end", substr(text, start + 1, stop - start) as text
  from cuts where chunk > 0""")
def pages_chunk(spark, sf):
    return pg.chunk(corpora.documents(spark, sf), 400)


# --- clean-up and detectors --------------------------------------------------

@query("preprocess_line_breaks", o.with_(o.NOTES, o.prepared()) + "select doc_id, text from prepared")
def preprocess_line_breaks(spark, sf):
    return prepare(corpora.notes(spark, sf))


def _detector(name: str) -> None:
    @query(f"detect_{name}", o.detect(name))
    def run(spark, sf):
        return detect(corpora.notes(spark, sf), name).drop("ord")


for _name in [*fixed.PATTERN_PROFILE, "street"]:
    _detector(_name)


def _document_detector(name: str) -> None:
    source = r"plain as materialized (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as text from documents)"

    @query(f"detect_{name}_documents", o.detect(name, source, "plain"))
    def run(spark, sf):
        return detect(corpora.plain_documents(spark, sf), name).drop("ord")


for _name in ["phone", "address", "any_street", "place", "context_place", "name"]:
    _document_detector(_name)


@query("detect_email_documents", o.detect("email", "d0 as (select 1)", "documents"))
def detect_email_documents(spark, sf):
    return detect(corpora.documents(spark, sf), "email").drop("ord")


@query("bsn_eleven_proof", f"select distinct n as value, {o.bsn('n')} as valid from (select cast(100000000 + (o_orderkey * 7919) % 899999999 as varchar) as n from orders)")
def bsn_eleven_proof(spark, sf):
    numbers = corpora.table(spark, sf, "orders").select(
        F.expr("cast(100000000 + (o_orderkey * 7919) % 899999999 as string)").alias("value")).distinct()
    return numbers.select("value", F.expr(bsn_valid("value")).alias("valid"))


_DOSSIER = r"\b[Dd]ossier [A-Z]\b"
_CASE_LABEL = custom("case_label", "CASE", _DOSSIER, 0.9)
_AGE_LABEL = custom("event_year", "YEAR", r"\b\d{4}\b", 0.6, cues=["aangetroffen"], cue_window=25)


@query("detect_custom_labels", o.with_(o.NOTES, "d as (" + o._union([
    o._spans(o.find("notes", _DOSSIER), "CASE", 0.9, "case_label", 20, 20),
    o._spans(o.find("notes", r"\b\d{4}\b", 1), "YEAR", 0.6, "event_year", 20, 20,
             "contains(substr(lower(text), greatest(s - 25, 0) + 1, s - greatest(s - 25, 0)), 'aangetroffen')"),
]) + ")") + f"select {o.COLUMNS}, {o.CONTEXT} from d")
def detect_custom_labels(spark, sf):
    return detect_raw(corpora.notes(spark, sf), [_CASE_LABEL, _AGE_LABEL], context=True).drop("ord")


# --- union and overlap resolution --------------------------------------------

_RAW = 'select doc_id, s as start, e as "end", v as text, category, confidence, detector, cast(row_number() over (partition by doc_id order by rank, nr, i) - 1 as int) as ord from raw'


@query("union_patterns", o.with_(o.NOTES, o.raw()) + _RAW)
def union_patterns(spark, sf):
    return detect_raw(corpora.notes(spark, sf), "patterns")


@query("union_hybrid", o.with_(o.NOTES, o.raw(profile=fixed.HYBRID_PROFILE)) + _RAW)
def union_hybrid(spark, sf):
    return detect_raw(corpora.notes(spark, sf), "hybrid")


_FOUND = 'select doc_id, s as start, e as "end", v as text, category, confidence from '


@query("resolve_overlaps", o.with_(o.NOTES, o.raw(), o.resolved()) + _FOUND + "resolved")
def resolve_overlaps(spark, sf):
    return detect_all(corpora.notes(spark, sf)).select(*SPAN_COLUMNS)


@query("resolve_overlaps_table", o.with_(o.NOTES, o.raw(), o.resolved()) + _FOUND + "resolved")
def resolve_overlaps_table(spark, sf):
    return resolve_spans(detect_raw(corpora.notes(spark, sf))).select(*SPAN_COLUMNS)


@query("resolve_overlaps_documents", o.with_(
    r"plain as materialized (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as text from documents)",
    o.raw("plain"), o.resolved()) + _FOUND + "resolved")
def resolve_overlaps_documents(spark, sf):
    return detect_all(corpora.plain_documents(spark, sf)).select(*SPAN_COLUMNS)


@query("drop_masked_values", o.with_(o.NOTES, o.raw(), o.resolved()) + _FOUND + f"resolved where {o.UNMASKED}")
def drop_masked_values(spark, sf):
    return detect_all(corpora.notes(spark, sf), skip_masked=True).select(*SPAN_COLUMNS)


@query("select_categories", o.with_(o.NOTES, o.raw(), o.resolved()) + _FOUND + "resolved where category in ('PERSON', 'IBAN')")
def select_categories(spark, sf):
    return detect_all(corpora.notes(spark, sf), categories=["PERSON", "IBAN"]).select(*SPAN_COLUMNS)


# --- entities of external models ---------------------------------------------

def _map_labels(source: str, labels: str) -> None:
    table, other, lowered = ext.LABEL_MAPS[source]
    case = o.label_case(f"lower({labels})" if lowered else labels, table, "null" if other is None else "'MISC'")

    @query(f"entities_map_{source}", f"with {o.ENTITIES} select doc_id, ord, {labels} as label, {case} as category from entities"
           + (f" where {case} is not null" if other is None else ""))
    def run(spark, sf):
        return ext.map_labels(corpora.entities(spark, sf, labels), source).select("doc_id", "ord", "label", "category")


for _source, _labels in [("ner", "label"), ("hybrid", "label"), ("zero_shot", "zero_shot"), ("rule_engine", "rule_engine")]:
    _map_labels(_source, _labels)

_NER = o.label_case("label", fixed.NER_LABELS, "'MISC'")
_GOOD = rf"length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 2 and not contains(text, chr(10))"
_NER_CTE = f"""ner as (select *, {_NER} as category, cast(0.90 as double) as confidence from entities
  where {_NER} in ('PERSON', 'PLACE', 'ORG') and {_GOOD})"""


@query("entities_ner_filter", f"""with {o.ENTITIES}, {_NER_CTE} select doc_id, start, "end", text, category, confidence from (
  select *, row_number() over (partition by doc_id, start, "end" order by ord) as pick from ner) where pick = 1""")
def entities_ner_filter(spark, sf):
    return ext.ner_spans(corpora.entities(spark, sf)).select(*SPAN_COLUMNS)


@query("entities_merge_languages", f"""with {o.ENTITIES}, {_NER_CTE} select doc_id, start, "end", text, category, confidence, lang from (
  select *, row_number() over (partition by doc_id, start, "end" order by case lang when 'en' then 1 when 'nl' then 2 else 3 end, ord) as pick
  from ner where lang in ('en', 'nl', 'fr')) where pick = 1""")
def entities_merge_languages(spark, sf):
    return ext.merge_languages(corpora.entities(spark, sf), ["en", "nl", "fr"]).select(*SPAN_COLUMNS, "lang")


_HYB = o.label_case("label", fixed.HYBRID_LABELS)
_HYBRID_CTES = [
    o.NOTES, o.raw("notes", fixed.HYBRID_PROFILE), o.ENTITIES,
    f"""candidates as (select e.doc_id, e.start as s, e."end" as e, e.text as v, {_HYB} as category, cast(0.90 as double) as confidence, e.ord
      from entities e where {_HYB} in ('PERSON', 'PLACE', 'ORG') and {_GOOD.split(' and ')[0]} and not contains(text, '@') and lower(text) <> 'email')""",
    "free as (select c.* from candidates c anti join raw r on c.doc_id = r.doc_id and c.s < r.e and c.e > r.s)",
    o.resolved("free", "added", "ord"),
    "together as (select doc_id, s, e, v, category, confidence, 0 as src, rank, nr, i from raw union all "
    "select doc_id, s, e, v, category, 0.90, 1, 99, 0, s from added)",
    o.resolved("together", "resolved"),
]


@query("entities_hybrid_merge", o.with_(*_HYBRID_CTES) + _FOUND + "resolved")
def entities_hybrid_merge(spark, sf):
    raw = stage(detect_raw(corpora.notes(spark, sf), "hybrid"), "raw-spans")
    return ext.hybrid_spans(raw, corpora.entities(spark, sf), include_org=True).select(*SPAN_COLUMNS)


_ZERO = o.label_case("lower(zero_shot)", fixed.ZERO_SHOT_LABELS, "'MISC'")


@query("entities_threshold", f"""with {o.ENTITIES} select doc_id, start, "end", text, {_ZERO} as category, score as confidence
  from entities where score >= 0.6 and zero_shot in ('Person', 'organization', 'city')""")
def entities_threshold(spark, sf):
    return ext.scored_spans(corpora.entities(spark, sf, "zero_shot"), "zero_shot", 0.6, ["Person", "organization", "city"]).select(*SPAN_COLUMNS)


@query("entities_personal_data", f"""with {o.ENTITIES} select doc_id, start, "end", text, {_ZERO} as category, score as confidence
  from entities where score >= 0.5 and zero_shot in ({o.qs(fixed.ZERO_SHOT_DEFAULT + fixed.ZERO_SHOT_EXTRA)})""")
def entities_personal_data(spark, sf):
    return ext.personal_data_spans(corpora.entities(spark, sf, "zero_shot"), extended=True).select(*SPAN_COLUMNS)


@query("entities_flat", o.with_(o.ENTITIES, f"""scored as (select doc_id, start as s, "end" as e, text as v,
  {o.label_case('rule_engine', fixed.RULE_ENGINE_LABELS, "'MISC'")} as category, score as confidence, ord from entities where score >= 0.5)""",
       o.resolved("scored", "resolved", "-confidence, s - e, ord")) + _FOUND + "resolved")
def entities_flat(spark, sf):
    return ext.scored_spans(corpora.entities(spark, sf, "rule_engine"), "rule_engine", flat=True).select(*SPAN_COLUMNS)


_LANGUAGE_NAME = "case o_orderkey % 5 when 0 then ' Dutch ' when 1 then 'FR' when 2 then 'español' when 3 then 'Deutsch' else 'it' end"


@query("language_codes", f"select language, case lower(trim(language)) when 'dutch' then 'nl' when 'español' then 'es' when 'deutsch' then 'de' "
       f"else lower(trim(language)) end as code, count(*) as n from (select {_LANGUAGE_NAME} as language from orders) group by 1, 2")
def language_codes(spark, sf):
    names = corpora.table(spark, sf, "orders").select(F.expr(_LANGUAGE_NAME).alias("language"))
    return names.groupBy("language", F.expr(ext.language_code("language")).alias("code")).agg(F.count("*").alias("n"))


@query("entities_chunk_offsets", o.detect("email", "d0 as (select 1)", "documents").replace(
    f"select {o.COLUMNS}, {o.CONTEXT}", 'select doc_id, s as start, e as "end", v as text'))
def entities_chunk_offsets(spark, sf):
    # found per chunk, shifted to the document; addresses hold no ". " or blank line
    chunks = stage(pg.chunk(corpora.documents(spark, sf), 20_000), "chunks")
    found = detect(chunks.withColumn("key", F.struct("doc_id", "chunk")), "email", key="key")
    local = found.select("key.doc_id", "key.chunk", "start", "end", "text")
    return ext.to_document_offsets(local, chunks).select("doc_id", "start", "end", "text")


# --- mapping -----------------------------------------------------------------

_MAP = "select scope, placeholder, category, num, norm, canonical, variations, occurrences from mapping"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return stage(kept_spans(prepare(corpora.notes(spark, sf))), "spans")


def _but(*categories: str) -> list[str]:
    return sorted(set(CATEGORIES.values()) - set(categories))


def _values(spark: SparkSession, sf: str, categories: list[str] | None = None) -> DataFrame:
    """Distinct raw values of some categories, or of all."""
    found = detect_raw(corpora.notes(spark, sf), categories=categories)
    return found.select(F.col("text").alias("value"), "category").distinct()


def _normaliser(name: str, category: str, wanted: list[str]) -> None:
    @query(f"normalise_{name}", o.with_(o.NOTES, o.raw(), "u as (select distinct v, category from raw)")
           + f"select v as value, category, {o.norm()} as norm from u where category {category}")
    def run(spark, sf):
        values = _values(spark, sf, wanted)
        return values.select("value", "category", F.expr(normalise("value", "category")).alias("norm"))


for _name, _category, _wanted in [("person", "= 'PERSON'", ["PERSON"]), ("phone", "= 'PHONE'", ["PHONE"]), ("iban", "= 'IBAN'", ["IBAN"]),
                                  ("other", "not in ('PERSON', 'PHONE', 'IBAN')", _but("PERSON", "PHONE", "IBAN"))]:
    _normaliser(_name, _category, _wanted)


@query("mapping_corpus", o.with_(*o.encoding(), o.mapping()) + _MAP)
def mapping_corpus(spark, sf):
    return flat_mapping(maps.build_mapping(_spans(spark, sf)))


@query("mapping_corpus_blocks", o.with_(*o.encoding(), o.mapping()) + _MAP)
def mapping_corpus_blocks(spark, sf):
    return flat_mapping(maps.build_mapping(_spans(spark, sf), blocks=16))


@query("mapping_per_document", o.with_(*o.encoding(), o.mapping(scope="doc_id")) + _MAP)
def mapping_per_document(spark, sf):
    return flat_mapping(maps.build_mapping(_spans(spark, sf), maps.DOCUMENT))


@query("mapping_per_document_in_row", o.with_(*o.encoding(), o.mapping(scope="doc_id")) + _MAP)
def mapping_per_document_in_row(spark, sf):
    return flat_mapping(entries_table(encode_each(corpora.notes(spark, sf))))


@query("mapping_export", o.with_(*o.encoding(), o.mapping()) + """select placeholder, canonical, variations, occurrences,
  cast(max(num) over (partition by category) as int) as counter, '1.0' as version from mapping""")
def mapping_export(spark, sf):
    base = _run_folder(spark, "export")
    files.write_mapping_json(stage(maps.build_mapping(_spans(spark, sf)), "mapping"), base, created="")
    lines = spark.read.schema(maps.ENTRY_SCHEMA).json(f"{base}/entries")
    counters = files.read_mapping_headers(spark, base).select("scope", "version", F.explode("statistics").alias("kind", "counter"))
    return lines.withColumn("kind", F.expr("regexp_extract(placeholder, '^(.*)_', 1)")).join(
        F.broadcast(counters), ["scope", "kind"]).select(  # one row per category
        "placeholder", "canonical", F.array_join("variations", "|").alias("variations"), "occurrences", "counter", "version")


@query("mapping_import", o.with_(*o.encoding(), o.mapping()) + f"""select placeholder, category, num,
  case when row_number() over (partition by n2 order by placeholder desc) = 1 then n2 end as norm, canonical, occurrences
  from (select *, {o.norm('canonical', 'category')} as n2 from mapping)""")
def mapping_import(spark, sf):
    base = _run_folder(spark, "import")
    files.write_mapping_json(stage(maps.build_mapping(_spans(spark, sf)), "mapping"), base, created="")
    return files.read_mapping_json(spark, base).select("placeholder", "category", "num", "norm", "canonical", "occurrences")


@query("mapping_extend", o.with_(*o.encoding(), o.mapping()) + _MAP)
def mapping_extend(spark, sf):
    """Mapping of the earlier half of the documents, extended by the later half."""
    spans = _spans(spark, sf)
    middle = spans.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    first = stage(maps.build_mapping(spans.where(F.col("doc_id") <= middle)), "mapping")
    return flat_mapping(maps.extend_mapping(first, spans.where(F.col("doc_id") > middle)))


@query("mapping_lookup", o.with_(*o.encoding(), o.mapping()) + """select t.token as placeholder, m.canonical, t.n from
  (select 'PERSON_' || format('{:03d}', o_orderkey + 1) as token, count(*) as n from orders group by 1) t left join mapping m on m.placeholder = t.token""")
def mapping_lookup(spark, sf):
    tokens = corpora.table(spark, sf, "orders").groupBy(
        F.format_string("PERSON_%03d", F.col("o_orderkey") + 1).alias("placeholder")).agg(F.count("*").alias("n"))
    return maps.originals(tokens, maps.build_mapping(_spans(spark, sf))).select("placeholder", "canonical", "n")


@query("mapping_show", o.with_(*o.encoding(), o.mapping()) + """select placeholder, canonical,
  case when contains(variations, '|') then replace(variations, '|', ', ') end as variations, occurrences from mapping""")
def mapping_show(spark, sf):
    return maps.show(maps.build_mapping(_spans(spark, sf)))


# --- strategies and encoding -------------------------------------------------

_REWRITTEN = "select doc_id, text from rewritten"


@query("encode_corpus", o.with_(*o.encoding(), o.mapping(), o.rewritten(o.valued(), "prepared")) + _REWRITTEN)
def encode_corpus(spark, sf):
    return encode(corpora.notes(spark, sf)).text


@query("encode_per_document", o.with_(*o.encoding(), o.mapping(scope="doc_id"), o.rewritten(o.valued("k.doc_id"), "prepared")) + _REWRITTEN)
def encode_per_document(spark, sf):
    return encode(corpora.notes(spark, sf), scope=maps.DOCUMENT).text


@query("encode_hybrid", o.with_(
    *[c.replace("from notes", "from prepared") for c in [o.NOTES, o.prepared()]],
    o.raw("prepared", fixed.HYBRID_PROFILE), *_HYBRID_CTES[2:], o.kept(), o.mapping(),
    o.rewritten(o.valued(), "prepared")).replace("from prepared)", "from notes)", 1) + _REWRITTEN)
def encode_hybrid(spark, sf):
    return encode(corpora.notes(spark, sf), profile="hybrid", entities=corpora.entities(spark, sf), include_org=True).text


def _model_alone(profile: str, labels: str, *ctes: str) -> None:
    @query(f"encode_model_{profile}", o.with_(o.NOTES, o.prepared(), o.ENTITIES, *ctes, o.resolved("scored", "resolved", "-confidence, s - e, ord"),
           o.kept(), o.mapping(), o.rewritten(o.valued(), "prepared")) + _REWRITTEN)
    def run(spark, sf):
        return encode(corpora.notes(spark, sf), profile=profile, entities=corpora.entities(spark, sf, labels)).text


_model_alone("ner", "label", _NER_CTE, """scored as (select doc_id, start as s, "end" as e, text as v, category, confidence, ord from (
  select *, row_number() over (partition by doc_id, start, "end" order by ord) as pick from ner) where pick = 1)""")
for _source, _table, _column in [("zero_shot", fixed.ZERO_SHOT_LABELS, "lower(zero_shot)"), ("rule_engine", fixed.RULE_ENGINE_LABELS, "rule_engine")]:
    _model_alone(_source, _source, f"""scored as (select doc_id, start as s, "end" as e, text as v,
      {o.label_case(_column, _table, "'MISC'")} as category, score as confidence, ord from entities where score >= 0.5)""")


def _strategy(name: str, value: str, **options) -> None:
    @query(f"encode_{name}", o.with_(*o.encoding(), o.rewritten(f"select doc_id, s, e, {value} as value from kept", "prepared")) + _REWRITTEN)
    def run(spark, sf):
        return sanitise(corpora.notes(spark, sf), name, **options)


_strategy("redact", "'[' || category || ']'")
_strategy("mask", o.mask())
_strategy("hash", "substr(sha256('pepper' || v || category), 1, 16)", salt="pepper")


@query("encode_unmasked_values", o.with_(*o.encoding()[:-1], o.kept(where="true"), o.rewritten("select doc_id, s, e, '[REDACTED]' as value from kept", "prepared")) + _REWRITTEN)
def encode_unmasked_values(spark, sf):
    return sanitise(corpora.notes(spark, sf), "redact", include_category=False, skip_masked=False)




_VALUES = o.with_(o.NOTES, o.raw(), "u as (select distinct v, category from raw)")


def _mask_query(name: str, category: str, wanted: list[str]) -> None:
    @query(f"mask_{name}", _VALUES + f"select v as value, category, {o.mask()} as masked from u where category {category}")
    def run(spark, sf):
        masked = F.expr(get_strategy("mask").sql("value", "category")).alias("masked")
        return _values(spark, sf, wanted).select("value", "category", masked)


for _name, _category, _wanted in [("words", "not in ('EMAIL', 'PHONE', 'IBAN')", _but("EMAIL", "PHONE", "IBAN")), ("email", "= 'EMAIL'", ["EMAIL"]),
                                  ("phone", "= 'PHONE'", ["PHONE"]), ("iban", "= 'IBAN'", ["IBAN"])]:
    _mask_query(_name, _category, _wanted)


@query("hash_algorithms", _VALUES + """select v as value, category, sha256(v || category) as sha256, substr(md5('s' || v || category), 1, 16) as md5,
  substr(sha256(v || category), 1, 16) as other from u""")
def hash_algorithms(spark, sf):
    make = lambda **kw: F.expr(get_strategy("hash", **kw).sql("value", "category"))
    return _values(spark, sf).select(
        "value", "category", make(truncate=None).alias("sha256"), make(algorithm="md5", salt="s").alias("md5"),
        make(algorithm="unheard-of").alias("other"))


_KEY = "0123456789abcdef"


@query("encrypt_round_trip", _VALUES + "select v as value, category, v as restored, true as hidden from u")
def encrypt_round_trip(spark, sf):
    sealed = stage(_values(spark, sf).withColumn("sealed", F.expr(encrypt(_KEY).sql("value", "category"))), "sealed")
    # The cipher is nonce, as many bytes as the value, and tag.
    plain, cipher = F.col("value").cast("binary"), F.unbase64("sealed")
    hidden = (F.length(cipher) == F.length(plain) + 28) & (cipher != plain)
    return sealed.select("value", "category", F.expr(decrypt("sealed", _KEY)).alias("restored"), hidden.alias("hidden"))


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"k{i}", bytes(range(i, i + 16))) for i in range(3)], "key_id string, key binary")


@query("encrypt_with_key_table", o.with_(o.NOTES, o.prepared()) + "select doc_id, text as restored, true as hidden from prepared")
def encrypt_with_key_table(spark, sf):
    """Values sealed under a key of a table, in the texts, and put back."""
    done = encode(corpora.notes(spark, sf), strategy="encrypt", keys=_keys(spark), key_id="k1")
    texts = stage(done.text, "texts")
    restored = sealing.restore(texts, _keys(spark)).withColumnRenamed("text", "restored")
    return restored.join(texts, "doc_id").select("doc_id", "restored", (~F.col("text").contains("@example.com")).alias("hidden"))


@query("encrypt_rotate_keys", _VALUES + """select v as value, category, 'k' || (length(v) % 2) as before, 'k2' as after, v as restored from u""")
def encrypt_rotate_keys(spark, sf):
    """Values under two keys, all of them under a third one after rotation."""
    keys, values = _keys(spark), stage(_values(spark, sf), "values")  # searched once for both keys
    parts = [sealing.seal(values.where(F.length("value") % 2 == i), keys, f"k{i}") for i in (0, 1)]
    sealed = stage(parts[0].unionByName(parts[1]).withColumn("before", F.regexp_extract("sealed", "^<([^:]+):", 1)), "sealed")
    rotated = stage(sealing.rotate(sealed, keys, "k2"), "rotated")
    return sealing.unseal(rotated, keys, into="restored").select(
        "value", "category", "before", F.regexp_extract("sealed", "^<([^:]+):", 1).alias("after"), "restored")


@query("strategy_replace_standalone", _VALUES + """select v as value, category,
  category || '_' || format('{:03d}', row_number() over (partition by category order by v)) as placeholder from u""")
def strategy_replace_standalone(spark, sf):
    """Every value its own number, in value order, without entity resolution."""
    values = _values(spark, sf).select(
        F.lit(0).cast("bigint").alias("scope"), F.concat_ws("|", "category", "value").alias("norm"), "category",
        F.col("value").alias("canonical"), F.array("value").alias("variations"), F.lit(1).cast("bigint").alias("occurrences"),
        F.col("value").alias("first_doc"), F.lit(0).alias("first_back"))
    return maps.number(values).select(F.col("canonical").alias("value"), "category", "placeholder")


@query("strategy_custom", o.with_(*o.encoding(), o.rewritten(
    "select doc_id, s, e, '<' || lower(category) || ':' || length(v) || '>' as value from kept", "prepared")) + _REWRITTEN)
def strategy_custom(spark, sf):
    own = Strategy("tagged", column=lambda value, category: F.concat(
        F.lit("<"), F.lower(category), F.lit(":"), F.length(value).cast("string"), F.lit(">")))
    return encode(corpora.notes(spark, sf), strategy=own).text


@query("strategy_keeps_mapping", o.with_(*o.encoding(), o.mapping()) + _MAP)
def strategy_keeps_mapping(spark, sf):
    return flat_mapping(encode(corpora.notes(spark, sf), strategy="redact").mapping)


def _encoded_text(name: str, value: str, **options) -> None:
    @query(f"encode_text_{name}", o.with_(*o.encoding(), o.rewritten(
        f"select doc_id, s, e, {value} as value from kept", "prepared")) + _REWRITTEN)
    def run(spark, sf):
        return encode(corpora.notes(spark, sf), strategy=name, **options).text


_encoded_text("redact", "'[' || category || ']'")
_encoded_text("mask", o.mask())
_encoded_text("hash", "substr(sha256('pepper' || v || category), 1, 16)", salt="pepper")


@query("encode_with_legend", o.with_(*o.encoding(), o.mapping(), o.rewritten(o.valued(), "prepared"), f"legend as ({o.legend()})")
       + "select r.doc_id, l.legend || r.text as text from rewritten r cross join legend l")
def encode_with_legend(spark, sf):
    done = encode(corpora.notes(spark, sf))
    return rep.with_legend(done.text, done.mapping)


@query("write_and_read_back", o.with_(*o.encoding(), o.mapping(), o.rewritten(o.valued(), "prepared"))
       + "select r.doc_id, r.text, (select count(*) from mapping) as entities from rewritten r")
def write_and_read_back(spark, sf):
    done = encode(corpora.notes(spark, sf))
    base = _run_folder(spark, "written")
    files.write_texts(done.text, f"{base}/texts")
    files.write_mapping_json(done.mapping, f"{base}/mapping", "")
    entities = files.read_mapping_json(spark, f"{base}/mapping").agg(F.count("*").alias("entities"))
    return spark.read.schema("doc_id bigint, text string").parquet(f"{base}/texts").join(F.broadcast(entities))  # one row


# --- decoding ----------------------------------------------------------------

_TOKEN = rf"\b({'|'.join(fixed.TOKEN_CATEGORIES)})_(\d{{3,4}})\b"


@query("find_placeholders", o.with_(o.NOTES) + f"""select doc_id, cast(i - 1 as int) as pos, c[i] as category, d[i] as digits from (
  select doc_id, c, d, unnest(range(1, len(c) + 1)) as i from (select doc_id, regexp_extract_all(text, {o.q(_TOKEN)}, 1) as c,
  regexp_extract_all(text, {o.q(_TOKEN)}, 2) as d from notes) where len(c) > 0)""")
def find_placeholders(spark, sf):
    return dec.find_placeholders(corpora.notes(spark, sf))


def _decoded_sql(name: str = "decoded") -> list[str]:
    token = r"\b[A-Z][A-Z0-9]*(?:_[A-Z][A-Z0-9]*)*_\d{3,}\b"
    tokens = f"tokens as materialized ({o.find('rewritten', token)})"
    value = "select t.doc_id, t.s, t.e, coalesce(m.canonical, t.v) as value from tokens t left join mapping m on m.placeholder = t.v"
    return [*o.encoding(), o.mapping(), o.rewritten(o.valued(), "prepared"), tokens, o.rewritten(value, "rewritten", name)]


@query("decode_corpus", o.with_(*_decoded_sql()) + "select doc_id, text from decoded")
def decode_corpus(spark, sf):
    done = encode(corpora.notes(spark, sf))
    return dec.decode(stage(done.text, "texts"), done.mapping)


@query("decode_from_files", o.with_(*_decoded_sql()) + "select doc_id, text from decoded")
def decode_from_files(spark, sf):
    done = encode(corpora.notes(spark, sf))
    base = _run_folder(spark, "decode")
    files.write_texts(done.text, f"{base}/texts")
    files.write_mapping_json(done.mapping, f"{base}/mapping", "")
    return dec.decode(files.read_documents(spark, f"{base}/texts"), files.read_mapping_json(spark, f"{base}/mapping"))


def _decoded_per_document_sql() -> list[str]:
    token = r"\b[A-Z][A-Z0-9]*(?:_[A-Z][A-Z0-9]*)*_\d{3,}\b"
    tokens = f"tokens as materialized ({o.find('rewritten', token)})"
    value = ("select t.doc_id, t.s, t.e, coalesce(m.canonical, t.v) as value from tokens t "
             "left join mapping m on m.placeholder = t.v and m.scope = t.doc_id")
    return [*o.encoding(), o.mapping(scope="doc_id"), o.rewritten(o.valued("k.doc_id"), "prepared"), tokens,
            o.rewritten(value, "rewritten", "decoded")]


@query("decode_per_document", o.with_(*_decoded_per_document_sql()) + "select doc_id, text from decoded")
def decode_per_document(spark, sf):
    """Placeholders that mean another value in each document."""
    # texts and mapping come from one search of the texts
    encoded = stage(encode_each(corpora.notes(spark, sf)), "encoded")
    return dec.decode(encoded.select("doc_id", "text"), entries_table(encoded), scope="document")


@query("validate_round_trip", o.with_(*_decoded_sql()) + """select n.doc_id, length(n.text) as original_length, length(r.text) as sanitized_length,
  length(d.text) as decoded_length, length(n.text) = length(d.text) as lengths_match, n.text = d.text as content_match,
  cast(x.i as int) as first_diff_position,
  substr(n.text, greatest(x.i - 20, 0) + 1, x.i + 20 - greatest(x.i - 20, 0)) as first_diff_original,
  substr(d.text, greatest(x.i - 20, 0) + 1, x.i + 20 - greatest(x.i - 20, 0)) as first_diff_decoded
  from notes n join rewritten r on n.doc_id = r.doc_id join decoded d on n.doc_id = d.doc_id,
  lateral (select min(j) as i from (select unnest(range(0, least(length(n.text), length(d.text)))) as j) where n.text[j + 1] <> d.text[j + 1]) x""")
def validate_round_trip(spark, sf):
    docs = corpora.notes(spark, sf)
    done = encode(docs)
    sanitised = stage(done.text, "texts")
    decoded = dec.decode(sanitised, done.mapping)
    texts = (
        docs.withColumnRenamed("text", "original")
        .join(sanitised.withColumnRenamed("text", "sanitised"), "doc_id")
        .join(decoded.withColumnRenamed("text", "decoded"), "doc_id")
    )
    return dec.validate(texts)


# --- reports -----------------------------------------------------------------

@query("report_statistics", o.with_(*o.encoding(), o.mapping()) + """select category, count(*) as unique_values, cast(sum(occurrences) as bigint) as occurrences,
  string_agg(case when num <= 3 then placeholder || ' → ' || case when length(canonical) > 30 then substr(canonical, 1, 30) || '...' else canonical end end,
  '; ' order by num) as examples from mapping group by category
  union all select null, count(*), cast(sum(occurrences) as bigint), null from mapping""")
def report_statistics(spark, sf):
    return rep.statistics(maps.build_mapping(_spans(spark, sf)))


@query("report_legend", o.with_(*o.encoding(), o.mapping(scope="doc_id")) + o.legend())
def report_legend(spark, sf):
    return rep.legend(maps.build_mapping(_spans(spark, sf), maps.DOCUMENT))


@query("report_analyse", o.with_(o.NOTES, o.raw(), o.resolved(), "r as (select *, row_number() over (partition by doc_id, category order by s) as k from resolved)")
       + """select doc_id, category, count(*) as found, string_agg(case when k <= 5 then v end, '; ' order by k) as examples,
  greatest(count(*) - 5, 0) as more from r group by doc_id, category
  union all select doc_id, null, count(*), null, null from r group by doc_id""")
def report_analyse(spark, sf):
    return rep.analyse(corpora.notes(spark, sf))


@query("report_analyse_documents", o.with_(o.NOTES, o.raw(), o.resolved(), "r as (select *, row_number() over (partition by doc_id, category order by s) as k from resolved)")
       + """select doc_id, category, count(*) as found, string_agg(case when k <= 5 then v end, '; ' order by k) as examples,
  greatest(count(*) - 5, 0) as more, null as chars from r group by doc_id, category
  union all select n.doc_id, null, count(r.doc_id), null, null, length(n.text) from notes n left join r on r.doc_id = n.doc_id group by n.doc_id, n.text""")
def report_analyse_documents(spark, sf):
    return rep.analyse_documents(corpora.notes(spark, sf))


@query("report_dry_run", o.with_(*o.encoding(), o.mapping()) + "select placeholder, canonical from mapping")
def report_dry_run(spark, sf):
    return rep.dry_run(encode(corpora.notes(spark, sf)).mapping)


# ASCII text only: the SQL engine's word edges are.
_ASCII = "[^\\x00-\\x7F]"
_PLAIN_PAGES = f"""page_text as (select doc_id, page_no, regexp_replace(native_text, '{_ASCII}', '_', 'g') as native_text,
  regexp_replace(ocr_text, '{_ASCII}', '_', 'g') as ocr_text from ({corpora.PAGES_SQL}))"""


@query("convert_and_sanitise", "with " + _PLAIN_PAGES + _ASSEMBLED.removeprefix(o.PAGES) + f""", parts as materialized (
  select doc_id as d, cast(nr // 2 + 1 as int) as part, string_agg(p, chr(10) || chr(10) order by nr) as text,
  row_number() over (order by doc_id, nr // 2) as doc_id from ({_PIECES}) group by d, nr // 2), """ + o.with_(
    o.prepared(source="parts"), o.raw("prepared"), o.resolved(), o.kept(), o.mapping(), o.rewritten(o.valued(), "prepared"),
    f"legend as ({o.legend()})").removeprefix("with ")
    + """select p.d as doc_id, p.part, coalesce(l.legend, '') || r.text as text
  from rewritten r join parts p on r.doc_id = p.doc_id left join legend l on true""")
def convert_and_sanitise(spark, sf):
    """Pages to parts to sanitised parts, one mapping for all of them, legend on top."""
    plain = {c: F.regexp_replace(c, r"[^\x00-\x7F]", "_") for c in ("native_text", "ocr_text")}
    return convert(corpora.page_text(spark, sf).withColumns(plain), max_pages=2).text


@query("convert_and_sanitise_unicode")
def convert_and_sanitise_unicode(spark, sf):
    """convert_and_sanitise on the pages as they are; beyond the SQL engine's word edges, so tests hold it against plain regexes."""
    return convert(corpora.page_text(spark, sf), max_pages=2).text


def _unicode_document_detector(name: str) -> None:
    @query(f"detect_{name}_documents_unicode")
    def run(spark, sf):
        return detect(corpora.documents(spark, sf), name).drop("ord")


for _name in ["phone", "address", "any_street", "place", "context_place", "name"]:
    _unicode_document_detector(_name)


@query("resolve_overlaps_documents_unicode")
def resolve_overlaps_documents_unicode(spark, sf):
    return detect_all(corpora.documents(spark, sf)).select(*SPAN_COLUMNS)


# --- streams -----------------------------------------------------------------

def _streamed_notes(spark: SparkSession, sf: str, stream_of: DataFrame, rows: int) -> DataFrame:
    """The notes of a stream of orders, of which a batch has about so many rows."""
    customers = corpora.table(spark, sf, "customer").select("c_custkey")
    joined = stream_of.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return deal(joined, rows, "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("doc_id"), F.expr(corpora.NOTE).alias("text"))


def _note_stream(spark: SparkSession, sf: str) -> DataFrame:
    orders = corpora.table(spark, sf, "orders")
    stream_of = spark.readStream.schema(orders.schema).parquet(f"{sf}/orders*.parquet")
    return _streamed_notes(spark, sf, stream_of, orders.count())


@query("stream_redact", ORACLE["encode_redact"])
def stream_redact(spark, sf):
    base = _run_folder(spark, "stream-redact")
    cleaned = stream.sanitise_stream(_note_stream(spark, sf), "redact")
    (cleaned.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("doc_id bigint, text string").parquet(f"{base}/out")


@query("stream_encode", ORACLE["encode_corpus"])
def stream_encode(spark, sf):
    base = _run_folder(spark, "stream-encode")
    stream.encode_stream(_note_stream(spark, sf), f"{base}/mapping", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id bigint, text string").parquet(f"{base}/out").select("doc_id", "text")


def _note_batches(spark: SparkSession, sf: str, base: str, batches: int = 4, files_each: int = 4) -> DataFrame:
    """The notes as a stream of several batches of ascending orders, one set of files each."""
    orders = corpora.table(spark, sf, "orders")
    bounds = orders.agg(F.percentile_approx("o_orderkey", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = orders if low is None else orders.where(F.col("o_orderkey") > low)
        part = part if high is None else part.where(F.col("o_orderkey") <= high)
        part.repartition(files_each, "o_orderkey").write.mode("append").parquet(f"{base}/orders")
    stream_of = (
        spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", files_each).parquet(f"{base}/orders"))
    return _streamed_notes(spark, sf, stream_of, orders.count() // batches)


def _streamed_in_batches(spark: SparkSession, sf: str) -> str:
    base = _run_folder(spark, "stream-batches")
    # compacted once on the way, so that the mapping comes from a snapshot and the changes after it
    stream.encode_stream(_note_batches(spark, sf, base), f"{base}/mapping", f"{base}/out", f"{base}/checkpoint",
                         compact_every=3).awaitTermination()
    return base


@query("stream_encode_batches", ORACLE["encode_corpus"])
def stream_encode_batches(spark, sf):
    """Several batches with one carried mapping give what the whole corpus gives at once."""
    base = _streamed_in_batches(spark, sf)
    return spark.read.schema("doc_id bigint, text string").parquet(f"{base}/out").select("doc_id", "text")


@query("stream_mapping_batches", ORACLE["mapping_corpus"])
def stream_mapping_batches(spark, sf):
    """The carried mapping after the last batch: a snapshot and the changes after it."""
    base = _streamed_in_batches(spark, sf)
    return flat_mapping(stream.MappingLog(spark, f"{base}/mapping").read(1 << 40))


# --- text files --------------------------------------------------------------

_NAME = "'note-' || lpad(cast({} as varchar), 10, '0') || '{}.txt' as name"


def _note_files(spark: SparkSession, sf: str, base: str) -> DataFrame:
    """The notes as text files, one each, read again: doc_id is the rank of the path."""
    named = corpora.notes(spark, sf).select(F.format_string("note-%010d.txt", "doc_id").alias("name"), "text")
    files.write_text_files(named, f"{base}/in")
    return files.output_names(files.read_texts(spark, f"{base}/in"))


def _written(spark: SparkSession, path: str) -> DataFrame:
    return files.read_texts(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@query("encode_text_files", o.with_(*o.encoding(), o.mapping(), o.rewritten(o.valued(), "prepared"))
       + f"select {_NAME.format('doc_id', '_sanitized')}, text from rewritten")
def encode_text_files(spark, sf):
    """Text files in, sanitised text files with derived names out."""
    base = _run_folder(spark, "text-files")
    texts = _note_files(spark, sf, base)
    done = encode(texts.select("doc_id", "text"))
    files.write_text_files(done.text.join(texts.select("doc_id", "sanitized_name"), "doc_id"), f"{base}/out", "sanitized_name")
    return _written(spark, f"{base}/out")


@query("decode_text_files", o.with_(*_decoded_sql()) + f"select {_NAME.format('doc_id', '_sanitized_decoded')}, text from decoded")
def decode_text_files(spark, sf):
    """Sanitised text files and a mapping file back to decoded text files."""
    base = _run_folder(spark, "text-files")
    texts = _note_files(spark, sf, base)
    done = encode(texts.select("doc_id", "text"))
    files.write_text_files(done.text.join(texts.select("doc_id", "sanitized_name"), "doc_id"), f"{base}/out", "sanitized_name")
    files.write_mapping_json(done.mapping, f"{base}/mapping", "")
    sanitised = files.output_names(files.read_texts(spark, f"{base}/out"))
    decoded = dec.decode(sanitised.select("doc_id", "text"), files.read_mapping_json(spark, f"{base}/mapping"))
    files.write_text_files(decoded.join(sanitised.select("doc_id", "decoded_name"), "doc_id"), f"{base}/decoded", "decoded_name")
    return _written(spark, f"{base}/decoded")
