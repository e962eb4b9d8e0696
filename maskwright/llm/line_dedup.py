"""Line deduplication on DataFrame functions alone.

Hashes of long lines are range-partitioned by (hash, group of documents) and sorted by document; a running rank streams
over them, and only the first few documents of each piece go on to a second, bounded look at the whole hash. The result
is no text but a compressed keep bitmap for each document that loses a line; `drop_lines` applies the bitmaps.

A key (line stripped of ASCII white space at both ends, A-Z lower-cased) of at least `min_chars` code points in at least
`min_docs` documents loses all its lines except those in the largest doc_id holding it.

Defined cases: null or empty text is one empty line; a null doc_id is one document, smaller than all others; rows with
the same doc_id are one document, their lines decided alike; other columns are not read, and `drop_lines` returns them
untouched, whatever their names; an empty table gives an empty result.

How a hot line stays bounded: a piece (hash, group) holds 1 / groups of its documents, and the range partitioning may
cut between pieces. Whatever its size, a piece decides all but its `min_docs + 1` largest documents alone: a document
with more than min_docs others before it is dropped, since the line is frequent and a larger holder is known. At most
groups * (min_docs + 1) documents of a hash meet in the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import discard, shuffle_partitions, staged, unused

STRIPPED = " \t\n\x0b\x0c\r"
WORD_BITS = 32


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(line_hash, doc_id, text_key, line_no) of each long line."""
    text = F.col(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"),
        F.posexplode(_lines(text)).alias("line_no", "line"))
    key = F.translate(F.btrim("line", F.lit(STRIPPED)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", key).where(F.length("key") >= min_chars)
    return keyed.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("line_hash"), "doc_id", "text_key", "line_no")


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_dropped and the keep bitmap of each document that loses a line.

    bitmap: array of (gap, drop), `gap` words of WORD_BITS lines that are all kept, then a word with the dropped lines' bits.
    """
    spark = docs.sparkSession
    groups = max(32, shuffle_partitions(spark))
    # Staged: range partitioning reads its input twice, the second time as 30 bytes a line.
    lines = staged(line_hashes(docs, min_chars, id_col, text_col), "lines")
    hashes = lines.withColumn(
        "piece", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    ordered = hashes.repartitionByRange("line_hash", "piece").sortWithinPartitions(
        "line_hash", "piece", F.desc_nulls_last("doc_id"), "line_no")
    largest_first = F.desc_nulls_last("doc_id")
    ranked = ordered.withColumn(
        "place", F.dense_rank().over(Window.partitionBy("line_hash", "piece").orderBy(largest_first)))
    ranked = staged(ranked.select("line_hash", "doc_id", "text_key", "line_no", "place"), "ranked")
    surely = ranked.where(F.col("place") > min_docs + 1).select("doc_id", "text_key", "line_no")
    whole = Window.partitionBy("line_hash")
    open_ = ranked.where(F.col("place") <= min_docs + 1).withColumn(
        "rank", F.dense_rank().over(whole.orderBy(largest_first))).withColumn("n_docs", F.max("rank").over(whole))
    dropped = surely.unionByName(
        open_.where((F.col("rank") > 1) & (F.col("n_docs") >= min_docs)).select("doc_id", "text_key", "line_no"))
    words = dropped.groupBy("doc_id", "text_key", F.floor(F.col("line_no") / WORD_BITS).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, line_no % {WORD_BITS}))").alias("drop"))
    listed = words.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "drop"))).alias("w"))
    bitmaps = staged(listed.select(
        "doc_id", "text_key",
        F.expr("aggregate(w, 0L, (n, x) -> n + bit_count(x.drop))").alias("n_dropped"),
        F.expr("transform(w, (x, i) -> named_struct('gap', x.word - coalesce(get(w, i - 1).word, -1) - 1, 'drop', x.drop))")
        .alias("bitmap")), "bitmaps")
    discard(lines, ranked)
    return bitmaps


def drop_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
    counts: bool = False, length_col: str | None = None,
) -> DataFrame:
    """docs with the text rid of its dropped lines; a column `length_col` gets the new text's length where lines went;
    with `counts`, also n_lines and n_dropped (for docs without columns of these names)."""
    doc, key, gone, kept_map, parts, drops = (unused(docs, f"__{n}") for n in ("b_doc", "b_key", "b_n", "b_map", "lines", "dense"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("n_dropped").alias(gone), F.col("bitmap").alias(kept_map))
    both = docs.join(
        bitmaps.hint("shuffle_hash"),
        docs[id_col].eqNullSafe(F.col(doc)) & (text_key(docs[text_col]) == F.col(key)), "left")
    dense = F.expr(f"flatten(transform({kept_map}, x -> concat(array_repeat(0L, x.gap), array(x.drop))))")
    lines = _lines(docs[text_col])
    kept = F.expr(
        f"array_join(filter({parts}, (x, i) -> (shiftright(coalesce(get({drops}, i div {WORD_BITS}), 0L), i % {WORD_BITS})"
        " & 1L) = 0L), '\\n')")
    out = both.withColumn(parts, lines).withColumn(drops, F.coalesce(dense, F.array().cast("array<bigint>")))
    text = F.when(F.col(gone).isNull(), docs[text_col]).otherwise(kept)
    changed = {text_col: text}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col(gone).isNull(), docs[length_col]).otherwise(
            F.length(kept).cast(docs.schema[length_col].dataType))
    columns = [changed.get(c, docs[c]).alias(c) for c in docs.columns]
    if counts:
        columns += [F.size(parts).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*columns)
