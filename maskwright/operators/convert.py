"""From scanned pages to sanitised parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.pages import MAX_PAGES, assemble, choose_text, split_parts
from maskwright.operators.reports import with_legend
from maskwright.operators.rewrite import Encoded, encode
from maskwright.session import stage


def convert(pages: DataFrame, max_pages: int = MAX_PAGES, legend: bool = True, unmarked: str = "slice", **options) -> Encoded:
    """Choose each page's text, assemble documents, split them and sanitise all
    parts with one mapping.  Text: doc_id, part, text; ``options`` are encode()'s.

    Parts are numbered in order by range partitions, so no product of ids can
    make two parts one.
    """
    parts = split_parts(assemble(choose_text(pages)), max_pages=max_pages, unmarked=unmarked)
    ordered = parts.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part")
    parts = stage(ordered.withColumn("row", F.monotonically_increasing_id()), "parts")
    done = encode(parts.select(F.col("row").alias("doc_id"), "text"), **options)
    text = with_legend(done.text, done.mapping) if legend else done.text
    named = text.withColumnRenamed("doc_id", "row").join(parts.select("row", "doc_id", "part"), "row")
    return Encoded(named.select("doc_id", "part", "text"), done.mapping)
