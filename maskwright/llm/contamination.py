"""Benchmark decontamination as a prefix-filtered set join.

Items and documents become shingles of `SHINGLE` words. A window of an item (`window` consecutive words; a shorter item
is one window) must share all its shingles with a place where it occurs, so its necessary prefix is one shingle: the
rarest in the documents. Only that one is joined; length and position bounds place the window around it, and equality
of all its words is the verification.

One pass over the texts, in tasks, keeps of each document only the runs of words whose shingles pass a fixed-size filter
of the items' shingles; everything after that is joins and aggregations of those runs.

Defined cases: null text has no words; a null doc_id is an id like others; rows with the same doc_id are told apart by
their texts, and equal rows get equal results; items with equal windows all count; items without words match nothing;
null item_ids are left out of the list and of the count; columns other than id and text are not read, and
`keep_clean` returns them untouched; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import discard, ship, staged, unused
from .line_dedup import text_key
from .texts import PUNCTUATION, Words, slices

#: Words in a shingle.
SHINGLE = 5
#: Shingles in a piece of a run.
PIECE = 32
#: Bits of the filter of item shingles: 4 MB, whatever the number of items. A full filter costs time, not results.
FILTER_BITS = 25

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    low = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(f"({WORD})"))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of each distinct window of each item."""
    words = items.select(F.col(id_col).alias("item_id"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    return words.withColumn("at", F.explode(starts)).select(
        "item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words")).distinct()


def _filter(windows: DataFrame) -> dict[int, np.ndarray]:
    """By shingle size (1 to SHINGLE), a bit map of fixed size over the hashes of the items' shingles.

    Built by tasks as bit positions, of which there are at most 2 ** FILTER_BITS per size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"), PUNCTUATION)
            h = words.hashes()
            sizes = np.minimum(words.counts, SHINGLE)
            for size in range(1, SHINGLE + 1):
                hashes, at = words.shingles(size, h)
                bits = hashes[sizes[words.text_of[at]] == size] >> np.uint64(64 - FILTER_BITS)
                bits = np.unique(bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bits), size, np.int32)), pa.array(bits)], names=["size", "bit"])

    texts = windows.select(F.array_join("words", " ").alias("text"))
    found = texts.mapInArrow(run, "size int, bit long").groupBy("size", F.floor(F.col("bit") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    maps = {}
    for size in range(1, SHINGLE + 1):
        mine = found.filter(pc.equal(found.column("size"), size))
        if mine.num_rows:
            bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
            bits[mine.column("word").to_numpy()] = mine.column("bits").to_numpy().view(np.uint64)
            maps[size] = bits
    return maps


def _runs(docs: DataFrame, maps: dict[int, np.ndarray], window: int) -> DataFrame:
    """One row per document: n_words, and its runs of words whose shingles of one size all pass the filter.

    A long run comes in pieces: each has `n` shingles of its own, from word `at` of it on, and the `window` words of the
    run before and after them, so any window over a shingle of its own is whole in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    run_type = pa.list_(pa.struct([
        ("size", pa.int32()), ("first", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("words", pa.list_(pa.string()))]))

    def find(words: Words) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in words.counts]
        h = words.hashes()
        text_of = words.text_of
        for size, bits in shared.value.items():
            hashes, at = words.shingles(size, h)
            bit = hashes >> np.uint64(64 - FILTER_BITS)
            hit = at[(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]
            if not len(hit):
                continue
            cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(text_of[hit]) > 0)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(hit)], strict=True):
                low, high = hit[a], hit[b - 1] + size
                doc = text_of[low]
                for start in range(low, hit[b - 1] + 1, PIECE):
                    stop = min(start + PIECE, hit[b - 1] + 1)
                    left, right = max(low, start - window), min(high, stop - 1 + size + window)
                    out[doc].append({
                        "size": size, "first": int(left - words.first[doc]), "at": int(start - left), "n": int(stop - start),
                        "words": [words.bytes_of(i).decode() for i in range(left, right)]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), PUNCTUATION)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words.counts.astype(np.int64)),
                     pa.array(find(words), run_type)],
                    names=["doc_id", "text_key", "n_words", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, text_key long, n_words long, "
             "runs array<struct<size: int, first: long, at: int, n: int, words: array<string>>>")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans [first word, words), item_ids (as strings, sorted) of each document."""
    ship(docs.sparkSession)
    of_items = staged(item_windows(items, window, item_id_col, item_text_col), "windows")
    windows = of_items.select("words").distinct()
    wanted = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        text_key(F.col(text_col)).alias("text_key"))
    runs = staged(_runs(wanted, _filter(windows), window), "runs")
    # Equal rows have equal runs; one of each is enough to join.
    places = runs.where(F.size("runs") > 0).select("doc_id", "text_key", F.explode("runs").alias("r")).distinct()
    tokens = places.select(
        "doc_id", "text_key", F.col("r.first").alias("first"), F.col("r.words").alias("run"), F.col("r.size").alias("size"),
        F.explode(F.expr("sequence(r.at, r.at + r.n - 1)")).alias("at"),
    ).withColumn("shingle", F.expr("array_join(slice(run, at + 1, size), ' ')"))
    holders = tokens.groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = (
        windows.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
        .withColumn("offset", F.explode(F.expr("sequence(0, size(words) - size)")))
        .withColumn("shingle", F.expr("array_join(slice(words, offset + 1, size), ' ')"))
        .join(holders, "shingle", "left")
        .groupBy("words").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("least"))
        .where("least.n > 0")  # a window with an unseen shingle is nowhere
        .select(F.col("words").alias("window"), "least.shingle", "least.offset")
    )
    hits = tokens.join(rarest, "shingle").where(
        (F.col("at") >= F.col("offset"))
        & (F.col("at") - F.col("offset") + F.size("window") <= F.size("run"))
    ).where(F.expr("slice(run, at - offset + 1, size(window)) = window"))
    hits = staged(hits.select(
        "doc_id", "text_key", (F.col("first") + F.col("at") - F.col("offset")).alias("start"), "window").distinct(), "hits")
    # Union of the windows' spans: a word is counted by the first window that covers it.
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "stop")
    spans = hits.select("doc_id", "text_key", "start", (F.col("start") + F.size("window")).alias("stop")).distinct()
    spans = spans.withColumn("reach", F.coalesce(
        F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.groupBy("doc_id", "text_key").agg(
        F.sum(F.greatest(F.col("stop") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found = hits.select("doc_id", "text_key", "window").distinct().join(
        of_items.withColumnRenamed("words", "window"), "window").where(F.col("item_id").isNotNull())
    found = found.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy(
        "doc_id", "text_key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    seen = spans.alias("s").join(
        found.alias("f"), F.expr("s.doc_id <=> f.doc_id and s.text_key = f.text_key"), "left").select(
        "s.doc_id", "s.text_key", "n_hit", "spans", "item_ids")
    result = staged(runs.alias("d").join(
        seen.alias("x"), F.expr("d.doc_id <=> x.doc_id and d.text_key = x.text_key"), "left").select(
        "d.doc_id", "d.text_key", "d.n_words", F.coalesce("x.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("x.spans", F.expr("array()").cast("array<struct<start: bigint, stop: bigint>>")).alias("spans"),
        F.coalesce("x.item_ids", F.expr("array()").cast("array<string>")).alias("item_ids")), "contamination")
    discard(of_items, runs, hits)
    return result


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any window of an item, with all their columns."""
    doc, key = unused(docs, "__hit_doc"), unused(docs, "__hit_key")
    hit = contamination(docs, items, window, id_col, text_col).where("n_hit > 0").select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(
        hit, docs[id_col].eqNullSafe(F.col(doc)) & (text_key(docs[text_col]) == F.col(key)), "left_anti")
