"""Entity resolution: which values are one entity, and its placeholder.

The key is the normalised value alone.  Category and main form come from the
first occurrence, where documents count in ascending order and positions
*within* a document from its end to its beginning; placeholders are numbered
per category in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.spans import lit
from maskwright.functions.text import category_of, normalise, placeholder
from maskwright.session import stage

CORPUS, DOCUMENT = "corpus", "document"
COLUMNS = ["scope", "placeholder", "category", "num", "norm", "canonical", "variations", "occurrences"]
SCHEMA = (
    "scope bigint, placeholder string, category string, num int, norm string, canonical string, "
    "variations array<string>, occurrences bigint"
)
def with_norm(spans: DataFrame) -> DataFrame:
    return spans.withColumn("norm", F.expr(normalise("text", "category")))


def entities(spans: DataFrame, scope: str = CORPUS, doc: str = "doc_id") -> DataFrame:
    """One row per entity: first occurrence, written forms, count.

    Occurrences are first reduced per written form, so a very frequent value
    leaves each task as one row.
    """
    keyed = spans if "norm" in spans.columns else with_norm(spans)
    scoped = keyed.withColumn("scope", F.col(doc) if scope == DOCUMENT else F.lit(0).cast("bigint"))
    first = F.struct(F.col(doc).alias("doc"), (-F.col("start")).alias("back"), F.col("category"), F.col("text"))
    forms = scoped.groupBy("scope", "norm", "text").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    return (
        forms.groupBy("scope", "norm")
        .agg(F.min("first").alias("first"), F.sum("n").alias("occurrences"),
             F.array_sort(F.collect_list("text")).alias("variations"))
        .select("scope", "norm", F.col("first.category").alias("category"), F.col("first.text").alias("canonical"),
                "variations", "occurrences", F.col("first.doc").alias("first_doc"), F.col("first.back").alias("first_back"))
    )


def _ranked(found: DataFrame, partitions: int | None) -> DataFrame:
    """Entities with ``num``: their rank in their category by first document and position.

    They are range-partitioned and sorted; a row's rank is its place in its partition's part of the category plus the rows
    of that category in the partitions before. Only counts by (category, partition) meet in a window, so neither a
    category nor a document is too large.
    """
    order = ["category", "first_doc", "first_back"]
    ranged = found.repartitionByRange(partitions, *order) if partitions else found.repartitionByRange(*order)
    placed = stage(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy("category", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("category").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("category", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    return (
        placed.join(starts, ["category", "_part"])
        .withColumn("num", F.col("_base") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_base")
    )


def number(found: DataFrame, scope: str = CORPUS, taken: DataFrame | None = None,
           blocks: int | None = None) -> DataFrame:
    """Give entities their placeholders.

    ``taken`` (category, top) holds numbers already used; ``blocks`` is the number of range partitions of a corpus (by
    default the session's).
    """
    if scope == DOCUMENT:
        window = Window.partitionBy("scope", "category").orderBy("first_doc", "first_back")
        ranked = found.withColumn("num", F.row_number().over(window))
    else:
        ranked = _ranked(found, blocks)
    if taken is not None:
        ranked = ranked.join(taken, "category", "left").withColumn("num", F.col("num") + F.coalesce(F.col("top"), F.lit(0)))
    return (
        ranked.withColumn("num", F.col("num").cast("int"))
        .withColumn("placeholder", F.expr(placeholder("category", "num")))
        .select(*COLUMNS)
    )


def build_mapping(spans: DataFrame, scope: str = CORPUS, blocks: int | None = None) -> DataFrame:
    return number(entities(spans, scope), scope, blocks=blocks)


def extension(known: DataFrame, found: DataFrame, taken: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows that further entities change or add: ``known`` values count up and collect forms, the others are numbered
    after the highest number of their category. known: mapping rows with a norm; found: see ``entities``."""
    more = found.select("norm", F.col("variations").alias("_forms"), F.col("occurrences").alias("_n"))
    updated = known.join(more, "norm").select(
        *[c for c in COLUMNS if c not in ("variations", "occurrences")],
        F.array_sort(F.array_union("variations", "_forms")).alias("variations"),
        (F.col("occurrences") + F.col("_n")).alias("occurrences"),
    )
    fresh = found.join(known.select("norm"), "norm", "left_anti")
    return updated.select(*COLUMNS).unionByName(number(fresh, CORPUS, taken, blocks))


def highest(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("category").agg(F.max("num").alias("top"))


def extend_mapping(mapping: DataFrame, spans: DataFrame, blocks: int | None = None) -> DataFrame:
    """Corpus mapping after further documents."""
    found = stage(entities(spans), "entities")
    untouched = mapping.join(found.select("norm"), "norm", "left_anti").select(*COLUMNS)
    return untouched.unionByName(extension(mapping, found, highest(mapping), blocks))


def originals(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Main form of each placeholder in ``tokens`` (null if unknown)."""
    return tokens.join(mapping.select("placeholder", "canonical"), "placeholder", "left")


def show(mapping: DataFrame) -> DataFrame:
    """Placeholders in string order; forms only where there are several."""
    return mapping.select(
        "placeholder", "canonical",
        F.when(F.size("variations") > 1, F.array_join("variations", ", ")).alias("variations"),
        "occurrences",
    ).orderBy("placeholder")


# --- mapping files -----------------------------------------------------------

ENTRY_SCHEMA = "scope bigint, placeholder string, canonical string, variations array<string>, occurrences bigint"
HEADER_SCHEMA = "scope bigint, version string, created string, statistics map<string,int>"
FILE_SCHEMA = (
    "version string, created string, statistics map<string,int>, "
    "mappings map<string,struct<canonical:string,variations:array<string>,occurrences:bigint>>"
)


def entries(mapping: DataFrame) -> DataFrame:
    """What a mapping file says of each placeholder: one row, one line of JSON."""
    return mapping.select("scope", "placeholder", "canonical", "variations", "occurrences")


def headers(mapping: DataFrame, created: str) -> DataFrame:
    """Version, date and the highest number of each category, one row per scope."""
    numbers = mapping.groupBy("scope", "category").agg(F.max("num").alias("top"))
    return numbers.groupBy("scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "top")))).alias("statistics")  # by category
    ).select("scope", F.lit(fixed.MAPPING_VERSION).alias("version"), F.lit(created).alias("created"), "statistics")


def from_entries(rows: DataFrame, order: str = "placeholder") -> DataFrame:
    """Mapping rows from the entries of mapping files.

    The key is rebuilt from the main form alone.  If two placeholders share it,
    the one that is later by ``order`` owns it and the other only serves decoding.
    """
    keyed = rows.withColumn("category", F.expr(category_of("placeholder"))).withColumn(
        "norm", F.expr(normalise("canonical", "category")))
    owners = keyed.groupBy(F.col("scope").alias("o_scope"), F.col("norm").alias("o_norm")).agg(F.max(order).alias("o_last"))
    owned = keyed.join(owners, F.expr("scope <=> o_scope and norm <=> o_norm"), "left")
    return owned.select(
        "scope", "placeholder", "category",
        F.expr(f"cast(regexp_extract(placeholder, {lit(r'_(\d+)$')}, 1) as int)").alias("num"),
        F.when(F.col(order) == F.col("o_last"), F.col("norm")).alias("norm"),
        "canonical",
        F.coalesce("variations", F.array("canonical")).alias("variations"),
        F.coalesce("occurrences", F.lit(1).cast("bigint")).alias("occurrences"),
    )


def to_json(mapping: DataFrame, created: str) -> DataFrame:
    """One JSON document per scope, in the layout of a single mapping file.

    Such a document is one value by nature; it is meant for the mapping of one
    document.  Corpora are written as lines (``sources.files``).
    """
    entry = F.struct("canonical", "variations", "occurrences")
    listed = mapping.groupBy("scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("placeholder"), entry.alias("entry"))))).alias("mappings"))
    return listed.join(headers(mapping, created), "scope").select(
        "scope", F.to_json(F.struct("version", "created", "statistics", "mappings")).alias("json"))


def from_json(files: DataFrame, json: str = "json", scope: str = "scope") -> DataFrame:
    """Mapping rows from JSON documents; within one, later entries own a shared key."""
    rows = (
        files.select(F.col(scope).cast("bigint").alias("scope"), F.from_json(json, FILE_SCHEMA).alias("f"))
        .select("scope", F.posexplode_outer(F.map_entries("f.mappings")).alias("pos", "e"))
        .where(F.col("e").isNotNull())
        .select("scope", "pos", F.col("e.key").alias("placeholder"), F.col("e.value.canonical").alias("canonical"),
                F.col("e.value.variations").alias("variations"), F.col("e.value.occurrences").alias("occurrences"))
    )
    return from_entries(rows, "pos")
