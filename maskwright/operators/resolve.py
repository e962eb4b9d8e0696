"""Overlap resolution on a span table (spans of several sources together)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import stage

BLOCK = 100_000


def _carry(rows: DataFrame, doc: str, value: str, name: str) -> DataFrame:
    """Largest ``value`` in the earlier blocks of the document."""
    blocks = rows.groupBy(doc, "block").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(doc).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(doc, "block", F.max("_top").over(earlier).alias(name))


def islands(spans: DataFrame, doc: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Add ``island``: the start of the run of overlapping spans a span is in.

    Running maxima are taken per (document, block of positions) and carried on
    from block to block, so one long document does not end up in one task.
    """
    rows = spans.withColumn("block", F.expr(f"start div {block}"))
    inside = Window.partitionBy(doc, "block").orderBy("start", "end")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.join(_carry(rows, doc, "end", "_carried"), [doc, "block"])
        .withColumn("_reach", F.greatest(F.max("end").over(before), F.col("_carried")))
        .withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start")))
    )
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(_carry(rows, doc, "_head", "_earlier"), [doc, "block"])
        .withColumn("island", F.coalesce(F.max("_head").over(up_to_here), F.col("_earlier")))
        .drop("block", "_carried", "_reach", "_head", "_earlier")
    )


def _near_islands(spans: DataFrame, doc: str) -> DataFrame:
    """The same as ``islands`` for documents whose spans all start in the first block: nothing is carried on."""
    inside = Window.partitionBy(doc).orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spans.withColumn("_reach", reach)
        .withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start")))
        .withColumn("island", F.max("_head").over(up_to_here))
        .drop("_reach", "_head")
    )


def by_confidence() -> list[Column]:
    """Default priority: confidence, then length, then production order."""
    return [-F.col("confidence"), F.col("start") - F.col("end"), F.col("ord")]


def resolve_spans(spans: DataFrame, priority: list[Column] | None = None, doc: str = "doc_id",
                  block: int = BLOCK) -> DataFrame:
    """Greedy choice of disjoint spans by ascending ``priority``.

    Of spans with equal positions only the first can survive, so copies are
    dropped (pre-aggregated) before islands are formed.
    """
    columns = [c for c in spans.columns if c not in (doc, "start", "end")]
    ranks = [c.alias(f"_p{i}") for i, c in enumerate(priority or by_confidence())]
    ranked = spans.select(doc, "start", "end", F.struct(*ranks, *[F.col(c) for c in columns]).alias("_s"))
    # used several times below, so it is written once; spans of no document or place are none
    distinct = stage(ranked.where(F.col(doc).isNotNull() & F.col("start").isNotNull()).groupBy(doc, "start", "end").agg(
        F.min("_s").alias("_s")), "positions")
    # Documents of more than one block, or of a later one, are few; only for them do blocks have to be joined.
    far = (F.col("start") >= block) | (F.col("start") <= -block)
    long = stage(distinct.where(far).select(doc).distinct(), "long-documents")
    near, spread_out = distinct.join(long, doc, "left_anti"), distinct.join(long, doc, "left_semi")
    kept = F.expr(
        "aggregate(slice(_a, 2, size(_a)), slice(_a, 1, 1), (acc, x) -> case when "
        "exists(acc, k -> k.start < x.end and k.end > x.start) then acc else concat(acc, array(x)) end)"
    )

    def chosen(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(doc, "island").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_s"), F.col("start"), F.col("end")))).alias("_a"))
        return (
            grouped.select(doc, F.explode_outer(kept).alias("_k"))
            .select(doc, "_k.start", "_k.end", *[F.col(f"_k._s.{c}").alias(c) for c in columns])
            .select(*spans.columns)
        )

    return chosen(_near_islands(near, doc)).unionByName(chosen(islands(spread_out, doc, block)))
