"""Reports on mappings and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.spans import lit, lits
from maskwright.functions.text import category_of
from maskwright.operators.detect import detect_all

EXAMPLES = 3
SHOWN = 5


def statistics(mapping: DataFrame) -> DataFrame:
    """Unique values, occurrences and first examples per category; the row
    without a category is the total."""
    rows = mapping.withColumn("category", F.expr(category_of("placeholder")))
    # numbers count up in insertion order, so the first examples are the lowest
    first = F.when(F.col("num") <= EXAMPLES, F.struct("num", F.concat(
        F.col("placeholder"), F.lit(" → "),
        F.when(F.length("canonical") > 30, F.concat(F.substring("canonical", 1, 30), F.lit("...")))
        .otherwise(F.col("canonical")))))
    return (
        rows.withColumn("example", first)
        .rollup("category")
        .agg(F.count("*").alias("unique_values"), F.sum("occurrences").alias("occurrences"),
             F.collect_list("example").alias("examples"))
        .withColumn("examples", F.when(F.col("category").isNotNull(), F.expr(
            "array_join(transform(array_sort(examples), e -> e.col2), '; ')")))
    )


def category_counts(mapping: DataFrame) -> DataFrame:
    return (
        mapping.groupBy("scope", F.expr(category_of("placeholder")).alias("category"))
        .agg(F.count("*").alias("n"))
    )


def legend(mapping: DataFrame) -> DataFrame:
    """The explanation of placeholders, one text per scope."""
    cases = " ".join(f"when {lit(c)} then {lit(d)}" for c, d in fixed.CATEGORY_TEXT.items())
    line = f"concat('  ', x.category, '_NNN : ', case x.category {cases} else 'Other' end, ' (', x.n, ' unique)')"
    lines = (
        f"concat(array({lits(fixed.LEGEND_HEAD)}), transform(array_sort(rows), x -> {line}), "
        f"array({lits(fixed.LEGEND_FOOT)}))"
    )
    return (
        category_counts(mapping).groupBy("scope").agg(F.collect_list(F.struct("category", "n")).alias("rows"))
        .select("scope", F.expr(f"array_join({lines}, '\\n')").alias("legend"))
    )


EMPTY_LEGEND = "\n".join(fixed.LEGEND_HEAD + fixed.LEGEND_FOOT)


def with_legend(texts: DataFrame, mapping: DataFrame, scope: str = "corpus") -> DataFrame:
    """Put the legend of a text's mapping in front of it."""
    legends = legend(mapping)
    if scope == "document":
        joined = texts.join(legends.withColumnRenamed("scope", "doc_id"), "doc_id", "left")
    else:
        of_corpus = F.broadcast(legends.where("scope = 0"))  # one row
        joined = texts.withColumn("scope", F.lit(0).cast("bigint")).join(of_corpus, "scope", "left")
    return joined.select("doc_id", F.concat(F.coalesce("legend", F.lit(EMPTY_LEGEND)), "text").alias("text"))


def analyse(docs: DataFrame, profile="patterns") -> DataFrame:
    """What would be found: per document and category the count and the first
    values by position; the row without a category is the document's total."""
    spans = detect_all(docs.select("doc_id", "text"), profile)
    rank = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("start"))
    shown = F.when(F.col("rank") <= SHOWN, F.struct("rank", "text"))
    counted = (
        spans.withColumn("rank", rank).withColumn("shown", shown)
        .rollup("doc_id", "category")
        .agg(F.count("*").alias("found"), F.collect_list("shown").alias("shown"))
        .where(F.col("doc_id").isNotNull())
    )
    more = F.when(F.col("category").isNotNull(), F.greatest(F.col("found") - SHOWN, F.lit(0)))
    return counted.select(
        "doc_id", "category", "found",
        F.when(F.col("category").isNotNull(), F.expr("array_join(transform(array_sort(shown), x -> x.text), '; ')")).alias("examples"),
        more.alias("more"),
    )


def text_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.length("text").alias("chars"))


def analyse_documents(docs: DataFrame, profile="patterns") -> DataFrame:
    """``analyse`` with the number of characters in each document's total, which documents without findings have too."""
    found = analyse(docs, profile).withColumnRenamed("doc_id", "_doc")
    return text_sizes(docs).join(found, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "category", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), "examples", "more",
        F.when(F.col("category").isNull(), F.col("chars")).alias("chars"))


def dry_run(mapping: DataFrame) -> DataFrame:
    """Placeholder and main form of every entity; nothing is written."""
    return mapping.select("placeholder", "canonical")
