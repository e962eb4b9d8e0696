"""Pages to documents, documents to parts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.spans import let, lit, strip, u

MIN_NATIVE = 50
SLICE = 500_000
MAX_PAGES = 500


def choose_text(pages: DataFrame) -> DataFrame:
    """Native text if it is long enough, else the OCR text if that is longer."""
    native, ocr = f"length({strip('native_text')})", f"length({strip('ocr_text')})"
    use_ocr = f"coalesce({native} < {MIN_NATIVE} and ocr_text != '' and {ocr} > {native}, false)"
    return pages.withColumn("from_ocr", F.expr(use_ocr)).withColumn(
        "text", F.when(F.col("from_ocr"), F.col("ocr_text")).otherwise(F.col("native_text")))


def page_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(~F.col("from_ocr")).alias("native_pages"),
        F.count_if(F.col("from_ocr")).alias("ocr_pages"),
    )


def assemble(pages: DataFrame) -> DataFrame:
    """One text per document: marked pages in order, blank lines between."""
    marked = "transform(array_sort(pages), p -> concat('--- Page ', p.page_no, ' ---\\n', p.text))"
    return (
        pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "text")).alias("pages"))
        .select("doc_id", F.expr(f"array_join({marked}, '\\n\\n')").alias("text"))
    )


def _slices(text: str, size: int) -> str:
    return (
        f"case when length({text}) = 0 then cast(array() as array<string>) else "
        f"transform(sequence(0, (length({text}) - 1) div {size}), i -> substring({text}, cast(i * {size} + 1 as int), {size})) end"
    )


def split_parts(docs: DataFrame, max_pages: int = MAX_PAGES, unmarked: str = "slice", size: int = SLICE) -> DataFrame:
    """Parts of at most ``max_pages`` pages: doc_id, part (from 1), text.

    Pages are what lies between page marks, trimmed, blank ones dropped.  Text
    without marks is cut into slices of ``size`` characters ('slice'), or taken
    as one page ('whole'); text of nothing but marks is sliced in both cases.
    """
    if unmarked not in ("slice", "whole"):
        raise ValueError("unmarked must be 'slice' or 'whole'")
    mark = lit(u(fixed.PAGE_MARK))
    pages = f"filter(transform(split(text, {mark}, -1), p -> {strip('p')}), p -> p != '')"
    if unmarked == "slice":
        pages = f"case when regexp_like(text, {mark}) then {pages} else {_slices('text', size)} end"
    parts = let("pages", pages, let(
        "pages", f"case when size(pages) = 0 then {_slices('text', size)} else pages end",
        "case when size(pages) = 0 then cast(array() as array<string>) else "
        f"transform(sequence(0, (size(pages) - 1) div {max_pages}), "
        f"i -> array_join(slice(pages, cast(i * {max_pages} + 1 as int), {max_pages}), '\\n\\n')) end"))
    return (
        docs.select("doc_id", F.expr(parts).alias("parts"))
        .select("doc_id", F.posexplode_outer("parts").alias("pos", "text"))
        .where(F.col("text").isNotNull())
        .select("doc_id", (F.col("pos") + 1).alias("part"), "text")
    )


def _last(text: str, mark: str, flipped: str) -> str:
    """Offset of the last ``mark`` in ``text``, -1 if there is none."""
    return (
        f"case when contains({text}, {lit(mark)}) then length({text}) - instr(reverse({text}), {lit(flipped)}) "
        f"+ 1 - {len(mark)} else -1 end"
    )


def chunk(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """Cut long texts at a paragraph, else a sentence end past the middle, else
    hard: doc_id, chunk (from 0), start, end, text."""
    half = size // 2
    end = let("para", _last("piece", "\n\n", "\n\n"), let(
        "stop", _last("piece", ". ", " ."),
        f"case when acc.pos + {size} >= total then total "
        f"when para > {half} then acc.pos + para + 2 "
        f"when stop > {half} then acc.pos + stop + 2 else acc.pos + {size} end"))
    step = let("piece", f"substring(text, acc.pos + 1, {size})", let(
        "stop_at", end, "struct(stop_at as pos, concat(acc.out, array(struct(acc.pos as start, stop_at as end))) as out)"))
    # every chunk but the last is longer than half the size
    rounds = f"sequence(0, total div {half + 1})"
    cuts = let("total", "length(text)", (
        f"aggregate({rounds}, struct(0 as pos, cast(array() as array<struct<start:int,end:int>>) as out), "
        f"(acc, i) -> case when acc.pos < total then {step} else acc end, acc -> acc.out)"))
    return (
        docs.select("doc_id", "text", F.expr(cuts).alias("cuts"))
        .select("doc_id", "text", F.posexplode_outer("cuts").alias("chunk", "c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", "chunk", F.col("c.start").alias("start"), F.col("c.end").alias("end"),
                F.expr("substring(text, c.start + 1, c.end - c.start)").alias("text"))
    )
