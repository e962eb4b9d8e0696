"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles; equal sets form a class, which its smallest doc_id stands for. A signature is
`values` b-bit MinHash values, the distance of two is the number of values that differ. By the pigeonhole principle two
signatures within `limit` differ in at most `limit // chunks` values of some chunk; with one error allowed a chunk, the
chunk without each of its values in turn is a key, and such a pair shares one. So the keys find every pair within the
limit, and the limit is set so that a pair of the asked similarity is beyond it with a probability of `MISS`.

Links are confirmed on the full sets, as far as components need it (see links.py); a pair beyond the signature limit is
not looked at.

Defined cases: null text, or text without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows with the same doc_id are one document; a null doc_id is linked with nothing and its
component_id is null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, ship, staged, unused
from .line_dedup import text_key
from .links import linked
from .texts import U64, Words, mix, slices

VALUES = 64
BITS = 16
#: Chance that one pair of exactly the asked similarity lies beyond the signature limit.
MISS = 1e-6

_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(0, 1 << 63, VALUES, np.uint64) * U64(2) + U64(1)
_TERMS = _random.integers(0, 1 << 63, VALUES, np.uint64)


def limit_of(percent: int) -> int:
    """The least distance that a pair of this similarity exceeds with a probability of at most MISS."""
    p = (1 - percent / 100) * (1 - 2.0 ** -BITS)
    tail = 1.0
    for k in range(VALUES + 1):
        tail -= comb(VALUES, k) * p ** k * (1 - p) ** (VALUES - k)
        if tail <= MISS:
            return k
    return VALUES


def chunks_of(limit: int) -> list[range]:
    """Chunks of the signature, as few as leave one error to the best of them."""
    n = limit // 2 + 1
    edges = [round(i * VALUES / n) for i in range(n + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, offsets by text), sorted within each text; short texts are one shingle."""
    h = words.hashes()
    parts, owners = [], []
    for k in range(1, size + 1):
        shingle, at = words.shingles(k, h)
        of = words.text_of[at]
        counts = words.counts[of]
        take = counts >= size if k == size else counts == k
        parts.append(shingle[take])
        owners.append(of[take])
    shingle, of = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    shingle, of = shingle[new], of[new]
    return shingle, np.searchsorted(of, np.arange(len(words.counts) + 1))


def _signatures(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, VALUES), "<u2")
    full = np.flatnonzero(np.diff(offsets))
    for k in range(VALUES if len(full) else 0):
        least = np.minimum.reduceat(shingle * _FACTORS[k] + _TERMS[k], offsets[full])
        out[full, k] = mix(least) >> U64(64 - BITS)
    return out


def _each_text(docs: DataFrame, run, schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield run(part)

    return docs.mapInArrow(over, schema)


def _described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (128 bits of the whole set), signature."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        shingle, offsets = _sets(Words(part.column("text")), size)
        one, two = (np.zeros(len(shingle) + 1, U64) for _ in range(2))
        np.cumsum(shingle, out=one[1:])
        np.cumsum(mix(shingle ^ U64(0x5851F42D4C957F2D)), out=two[1:])
        key = np.stack([np.diff(one[offsets]), np.diff(two[offsets])], axis=1)
        return pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("text_key"), pa.array(np.diff(offsets)),
            pa.array([row.tobytes() for row in key], pa.binary()),
            pa.array([row.tobytes() for row in _signatures(shingle, offsets)], pa.binary()),
        ], names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return _each_text(docs, run, "doc_id long, text_key long, n_shingles long, set_key binary, signature binary")


def _keys(classes: DataFrame, limit: int) -> DataFrame:
    """(key, node): 64-bit hashes of each chunk without each of its values."""
    chunks = chunks_of(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(n, VALUES)
            out = np.zeros((n, VALUES), U64)
            for number, chunk in enumerate(chunks):
                for left_out in chunk:
                    key = np.full(n, number * VALUES + left_out + 1, U64)
                    for i in chunk:
                        if i != left_out:
                            key = mix(key * U64(65537) + signature[:, i])
                    out[:, left_out] = key
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * VALUES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1).view(np.int64)))],
                names=["node", "keys"])

    return classes.select("node", "signature").mapInArrow(run, "node long, keys array<long>").select(
        "node", F.explode("keys").alias("key"))


def _near(limit: int):
    def near(sketches: pa.ChunkedArray):
        signature = np.frombuffer(b"".join(sketches.to_pylist()), "<u2").reshape(-1, VALUES)
        return lambda a, b: np.count_nonzero(signature[a] != signature[b], axis=1) <= limit

    return near


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of each document."""
    spark = docs.sparkSession
    ship(spark)
    limit = limit_of(percent)
    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        text_key(F.col(text_col)).alias("text_key"))
    described = staged(_described(wanted, shingle), "described")
    full = described.where("n_shingles > 0 and doc_id is not null")
    classes = staged(
        full.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")),
        "classes")
    keyed = _keys(classes, limit)
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader < most")
    members = staged(keyed.join(shared.select("key", "leader"), "key"), "members")
    # The sets of those that share a key with another; a class may stand for several rows, one of them is enough.
    asked = classes.join(members.select("node").distinct(), "node", "left_semi").select("set_key", "node")
    holders = full.join(asked, "set_key").where("doc_id = node").groupBy("node", "set_key").agg(
        F.min("text_key").alias("text_key"))
    texts = wanted.join(
        holders.select(F.col("node").alias("doc_id"), "text_key", "set_key"), ["doc_id", "text_key"])
    # Equal rows give equal sets, which do no harm below.
    described_sets = _set_rows(texts, shingle).join(
        classes.select("node", "set_key", F.col("signature").alias("sketch")), ["node", "set_key"])
    sets = staged(described_sets.select("node", F.size("elements").alias("size"), "sketch", "elements"), "sets")
    labels = linked(members, sets, _near(limit), percent)
    of_class = classes.select("set_key", "node").join(labels, "node", "left").select(
        "set_key", F.coalesce("label", "node").alias("label"))
    done = described.join(of_class, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles", "label")
    # Rows of one doc_id with different texts are one document: their classes have it as a common node.
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "doc_id"))
    result = staged(done.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    discard(described, classes, members, sets, labels)
    return result


def _set_rows(texts: DataFrame, size: int) -> DataFrame:
    """(node, set_key, elements): the whole set as 64-bit hashes."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        shingle, offsets = _sets(Words(part.column("text")), size)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("set_key"),
             pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(shingle.view(np.int64)))],
            names=["node", "set_key", "elements"])

    return _each_text(texts.select("doc_id", "set_key", "text"), run, "node long, set_key binary, elements array<long>")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near duplicates of one with a smaller doc_id, with all their columns."""
    doc, key = unused(docs, "__gone_doc"), unused(docs, "__gone_key")
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(
        gone, docs[id_col].cast("long").eqNullSafe(F.col(doc)) & (text_key(docs[text_col]) == F.col(key)), "left_anti")
