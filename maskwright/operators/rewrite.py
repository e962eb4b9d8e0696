"""Encoding: sanitised text and mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import BLOCK, blocks, let, runs
from maskwright.functions.strategies import Strategy, get_strategy
from maskwright.functions.text import join_broken_names, normalise, placeholder
from maskwright.operators import mapping as maps
from maskwright.operators.detect import Profile, detect_all, detect_raw, with_resolved
from maskwright.operators.external import MODEL_PROFILES, hybrid_spans, model_spans
from maskwright.operators.joins import attach, lookup
from maskwright.operators.sealing import seal
from maskwright.functions.resolve import is_masked
from maskwright.session import stage


@dataclass
class Encoded:
    text: DataFrame      # doc_id, text
    mapping: DataFrame   # see operators.mapping.SCHEMA


def rewrite(text: str, edits: str) -> str:
    """Replace disjoint spans, sorted by start, in one pass over the text.

    ``edits`` is an array of struct<start,end,value>."""
    def pieces(source: str, part: str, begin: str, offset: str) -> str:
        before = f"case when i = 0 then {begin} else get({part}, i - 1).end end"
        return (
            f"array_join(transform({part}, (e, i) -> "
            f"concat(substring({source}, {before} - {offset} + 1, e.start - {before}), e.value)), '')"
        )

    # Of many edits a block's stretch of the text is cut out once; its pieces come from there.
    begin = "case when k = 0 then 0 else element_at(get(parts, k - 1), -1).end end"
    cut = let("begin", begin, let(
        "stretch", f"substring({text}, begin + 1, element_at(part, -1).end - begin)", pieces("stretch", "part", "begin", "begin")))
    many = let("parts", blocks(edits), f"array_join(transform(parts, (part, k) -> {cut}), '')")
    return (
        f"case when {edits} is null or size({edits}) = 0 then {text} else "
        f"concat(case when size({edits}) <= {BLOCK} then {pieces(text, edits, '0', '0')} else {many} end, "
        f"substring({text}, element_at({edits}, -1).end + 1)) end"
    )


def prepare(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), F.expr(join_broken_names("text")).alias("text"))


def with_spans(prepared: DataFrame, profile: Profile, skip_masked: bool) -> DataFrame:
    """doc_id, text, spans. Steps are projections of their own: one expression of them all is nested too deep to analyse."""
    return with_resolved(prepared.select("doc_id", "text"), profile, skip_masked)


# --- without a shuffle -------------------------------------------------------

def sanitise(docs: DataFrame, strategy: str | Strategy = "redact", profile: Profile = "patterns",
             skip_masked: bool = True, **options) -> DataFrame:
    """Stateless strategies: each row is detected, rewritten and done."""
    chosen = get_strategy(strategy, **options)
    if chosen.sql is None:
        raise ValueError(f"strategy {chosen.name!r} needs encode()")
    value = chosen.sql("s.text", "s.category")
    edits = f"transform(spans, s -> struct(s.start as start, s.end as end, {value} as value))"
    return (
        with_spans(prepare(docs), profile, skip_masked).withColumn("edits", F.expr(edits))
        .select("doc_id", F.expr(rewrite("text", "edits")).alias("text"))
    )


def numbered_entities(spans: str) -> str:
    """Entities of one document, computed inside its row: array of struct<entry, members>.

    ``entry`` has norm, category, num, placeholder, canonical, variations, occurrences; ``members`` are its spans. Spans of
    one key lie together once they are sorted by it, so nothing is looked up.
    """
    keyed = (
        f"array_sort(transform(reverse({spans}), (s, i) -> struct({normalise('s.text', 's.category')} as norm, i as i, "
        "s.text as text, s.category as category, s.start as start, s.end as end)))"
    )
    firsts = (
        "array_sort(transform(" + runs("keyed", "x.norm != get(keyed, i - 1).norm")
        + ", g -> struct(g[0].i as i, g[0].category as category, g as g)))"
    )
    entry = (
        f"struct(f.g[0].norm as norm, c as category, i + 1 as num, {placeholder('c', 'i + 1')} as placeholder, "
        "f.g[0].text as canonical, array_sort(array_distinct(transform(f.g, o -> o.text))) as variations, "
        "cast(size(f.g) as bigint) as occurrences)"
    )
    # one pass for each category, of which there are few
    numbered = (
        "flatten(transform(array_distinct(transform(firsts, f -> f.category)), c -> "
        f"transform(filter(firsts, f -> f.category = c), (f, i) -> struct({entry} as entry, f.g as members))))"
    )
    return let("keyed", keyed, let("firsts", firsts, numbered))


def encode_each(docs: DataFrame, profile: Profile = "patterns", skip_masked: bool = True) -> DataFrame:
    """Placeholders with a fresh mapping per document; still one row in, one
    row out: doc_id, text, entries."""
    edits = (
        "array_sort(flatten(transform(found, f -> transform(f.members, "
        "m -> struct(m.start as start, m.end as end, f.entry.placeholder as value)))))"
    )
    found = f"case when size(spans) = 0 then null else {numbered_entities('spans')} end"
    return (
        with_spans(prepare(docs), profile, skip_masked)
        .select("doc_id", "text", F.expr(found).alias("found"))
        .select("doc_id", "text", F.expr(edits).alias("edits"), F.expr("transform(found, f -> f.entry)").alias("entries"))
        .select("doc_id", F.expr(rewrite("text", "edits")).alias("text"), "entries")
    )


def entries_table(encoded: DataFrame) -> DataFrame:
    """Mapping table of ``encode_each``; the scope is the document."""
    return (
        encoded.select("doc_id", F.explode_outer("entries").alias("e")).where(F.col("e").isNotNull())
        .select(F.col("doc_id").alias("scope"), "e.placeholder", "e.category", "e.num", "e.norm",
                "e.canonical", "e.variations", "e.occurrences")
    )


# --- with a mapping over the corpus ------------------------------------------

def kept_spans(prepared: DataFrame, profile: Profile = "patterns", skip_masked: bool = True,
               entities: DataFrame | None = None, include_org: bool = False, threshold: float = 0.5) -> DataFrame:
    """Spans to replace, with their keys: doc_id, start, end, text, category, norm.

    With entities of models the profile says whether they stand alone (``MODEL_PROFILES``) or beside the detectors.
    """
    model_alone = isinstance(profile, str) and profile in MODEL_PROFILES
    if model_alone and entities is None:
        raise ValueError(f"profile {profile!r} needs entities")
    if entities is None:
        spans = detect_all(prepared, profile, skip_masked)
    else:
        if model_alone:
            # only what lies in one of the documents
            spans = model_spans(entities, profile, threshold).join(prepared.select("doc_id"), "doc_id", "left_semi")
        else:
            raw = stage(detect_raw(prepared, profile), "raw-spans")
            spans = hybrid_spans(raw, entities, include_org)
        if skip_masked:
            spans = spans.where(~F.expr(is_masked("text")))
    return maps.with_norm(spans.select("doc_id", "start", "end", "text", "category"))


def replace_spans(prepared: DataFrame, valued: DataFrame) -> DataFrame:
    """Put the ``value`` of each span into its document."""
    edited = attach(prepared, valued, "doc_id", "edits", F.struct("start", "end", "value"))
    return edited.select("doc_id", F.expr(rewrite("text", "edits")).alias("text"))


def encode(docs: DataFrame, mapping: DataFrame | None = None, strategy: str | Strategy = "replace",
           profile: Profile = "patterns", scope: str = maps.CORPUS, skip_masked: bool = True,
           entities: DataFrame | None = None, include_org: bool = False, threshold: float = 0.5, doc: str = "doc_id",
           keys: DataFrame | None = None, key_id: str | None = None, **options) -> Encoded:
    """Sanitise documents and build (or extend) the mapping.

    ``profile`` names detectors (with ``entities``: besides the models' spans) or a kind of model, whose spans in
    ``entities`` are then all there is; ``threshold`` is the least score of scored entities. With ``keys`` (see
    ``operators.sealing``) the strategy is ``encrypt``, under the key of ``key_id``.

    Document scope rewrites each row in place.  Otherwise the text is prepared
    and searched once, and the values of the spans are joined to it.
    """
    chosen = Strategy("encrypt", reversible=True) if keys is not None else get_strategy(strategy, **options)
    if keys is not None and (strategy != "encrypt" or key_id is None):
        raise ValueError("keys go with strategy='encrypt' and a key_id")
    if scope == maps.DOCUMENT and mapping is not None:
        raise ValueError("a mapping can only be carried on with scope='corpus'")
    if scope == maps.DOCUMENT and chosen.name == "replace" and entities is None:
        encoded = encode_each(docs.withColumnRenamed(doc, "doc_id"), profile, skip_masked)
        return Encoded(encoded.select("doc_id", "text"), entries_table(encoded))

    prepared = prepare(docs, doc)
    spans = stage(kept_spans(prepared, profile, skip_masked, entities, include_org, threshold), "spans")
    if scope == maps.DOCUMENT:
        table = maps.build_mapping(spans, scope)
    elif mapping is None:
        table = stage(maps.build_mapping(spans), "mapping")
    else:
        table = stage(maps.extend_mapping(mapping, spans), "mapping")

    if chosen.name == "replace":
        if scope == maps.DOCUMENT:
            keyed = table.select(F.col("scope").alias("doc_id"), "norm", F.col("placeholder").alias("value"))
            valued = spans.join(keyed, ["doc_id", "norm"], "left")
        else:
            keyed = table.where(F.col("norm").isNotNull()).select("norm", F.col("placeholder").alias("value"))
            valued = lookup(spans, keyed, ["norm"])
    elif keys is not None:
        valued = seal(spans, keys, key_id, "text", "value")
    elif chosen.column is not None:
        valued = spans.withColumn("value", chosen.column(F.col("text"), F.col("category")))
    else:
        valued = spans.withColumn("value", F.expr(chosen.sql("text", "category")))
    return Encoded(replace_spans(prepared, valued), table)
