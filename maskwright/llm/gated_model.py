"""Scores by a gated recurrent language model, trained on the corpus with truncated backpropagation in numpy.

Words, by 64-bit hashes, are counted over all training documents. The `HEAD` most frequent (the end of a text counts as
one) are symbols of their own; the others are symbols by the power of two of their count, with an unseen word next to
those seen once. The output is factored: a softmax over classes, then over the words of a class for frequent words, or a
walk down the binary tree of all words of the count's band. Each counted word has a leaf of its own, so trees deepen with
the vocabulary; what the network decides at a node is a hashed row of weights, and a node's odds start at the numbers of
words on its two sides. On the input a counted word adds two hashed rows of its own to its band's symbol. Only words that no
training document has are alike; they are taken to be as many as those seen once and half as likely. So every text has a
proper probability.

Hashed rows are trained by plain gradient steps on the rows that a window touches, all other weights by Adam.

Training is data-parallel. In each round every task runs over its part of the training documents from the same weights,
in lanes that carry the state across windows and start each document anew; the weights are then averaged by tokens, in a
tree. Output biases start at the log counts, so the model starts as a unigram model. Scoring carries the state through
whole documents in the same way.

What grows with the corpus stays in Spark: counts are pre-aggregated in each chunk of documents, sent packed to the
bucket of their words' hashes, added up and numbered by band there, and joined back by (chunk, bucket). The driver sees
the head words, sums by bucket and band, and one set of weights.

Defined cases: null text is empty, its one token is the end; a null doc_id belongs to the training documents; rows with
one doc_id are scored each; without training documents base_score is 0 for every text and the model is uniform; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, ship, shuffle_partitions, staged
from .texts import U64, Words, mix, slices

HEAD_CLASSES, CLASS_WORDS = 32, 32
#: Frequent words with a symbol of their own.
HEAD = HEAD_CLASSES * CLASS_WORDS
BANDS = 40
SYMBOLS = HEAD + BANDS
#: The input before a document's first token.
BEGIN = SYMBOLS
CLASSES = HEAD_CLASSES + BANDS
#: Rows of weights that the nodes of the bands' trees, and the words outside the head on the input, are hashed to.
NODE_BITS, WORD_BITS = 13, 12
#: Rank of a token that has none: a frequent word, or one that no training document has.
NONE = 0xFFFFFFFF
#: Step of a hashed row by its summed gradient, and the number of visits from which it goes by their mean.
ROW_RATE, ROW_VISITS = 0.05, 8.0
#: Hash of the end of a text; no word has it but by chance.
END = 0x1E3779B97F4A7C15
CHUNK_TOKENS = 2_000_000
#: Tokens that lie side by side in lanes; many, so that a long document is a small part of them.
LAID_TOKENS = 3_000_000


@dataclass(frozen=True)
class Settings:
    hidden: int = 16
    lanes: int = 512
    window: int = 8
    rounds: int = 2
    rate: float = 0.01
    seed: int = 7


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the equal high bytes next to each other, for the file's compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _band(counts: np.ndarray) -> np.ndarray:
    """0 for words unseen or seen once, then by powers of two."""
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, BANDS - 1)


# Chunks of documents: tokens as numbers local to the chunk, and the hash behind each number. Local numbers follow the
# hashes, and buckets are ranges of hashes, so a chunk's counts are its buckets' counts one after the other.


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: a chunk's documents (bucket -1), and its words of one bucket with their training counts."""
    names = ["chunk", "bucket", "doc_ids", "held_out", "sizes", "tokens", "types", "seen"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(),
             pa.binary()]

    def rows(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def chunk(number: int, held: list) -> Iterator[pa.RecordBatch]:
        types, local = np.unique(np.concatenate([h for h, _, _, _ in held]), return_inverse=True)
        sizes = np.concatenate([n for _, n, _, _ in held])
        out = np.concatenate([x for _, _, _, x in held])
        seen = np.bincount(local[np.repeat(~out, sizes)], minlength=len(types)).astype("<u4")
        ids = [i for _, _, d, _ in held for i in d]
        yield rows([number], [-1], [ids], [out.tolist()], [sizes.tolist()], [_planes(local.astype("<u4"))], [None], [None])
        bucket = ((types >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
        stop = np.r_[cut[1:], len(types)]
        n = len(cut)
        yield rows([number] * n, bucket[cut].tolist(), [None] * n, [None] * n, [None] * n, [None] * n,
                   [types[i:j].tobytes() for i, j in zip(cut, stop, strict=True)],
                   [_planes(seen[i:j]) for i, j in zip(cut, stop, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, total = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                ends = words.first[1:] + np.arange(part.num_rows)
                hashes = np.full(len(words.start) + part.num_rows, END, U64)
                inside = np.ones(len(hashes), bool)
                inside[ends] = False
                hashes[inside] = words.hashes()
                held.append((hashes, words.counts + 1, part.column("doc_id").to_pylist(),
                             part.column("held_out").to_numpy(zero_copy_only=False)))
                total += len(hashes)
                if total >= CHUNK_TOKENS:
                    yield from chunk(number, held)
                    number, held, total = number + 1, [], 0
        if held:
            yield from chunk(number, held)

    return docs.mapInArrow(
        run, "chunk long, bucket int, doc_ids array<long>, held_out array<boolean>, sizes array<long>, tokens binary, "
             "types binary, seen binary")


def _counted(chunks: DataFrame) -> DataFrame:
    """Counts over all training documents, by bucket: rows (chunk, bucket, counts, places) for each chunk's words, and one
    row (chunk null) with what the bucket's words add up to in bands, and its most frequent words.

    places: a counted word's number among the bucket's words of its band, in order of hashes."""

    def by_bucket(table: pa.Table) -> pa.Table:
        types = [np.frombuffer(x.as_buffer(), U64) for x in table.column("types")]
        seen = np.concatenate([_unplanes(x.as_py(), "<u4") for x in table.column("seen")])
        words, each = np.unique(np.concatenate(types), return_inverse=True)
        count = np.bincount(each, seen, len(words)).astype(np.int64)
        back = np.split(count[each], np.cumsum([len(t) for t in types])[:-1])
        known = count > 0
        band = _band(count[known])
        by_band, in_band = np.argsort(band, kind="stable"), np.bincount(band, minlength=BANDS)
        place, nth = np.full(len(words), NONE, "<u4"), np.empty(len(band), "<u4")
        nth[by_band] = np.arange(len(band)) - np.repeat(np.cumsum(in_band) - in_band, in_band)
        place[known] = nth
        places = np.split(place[each], np.cumsum([len(t) for t in types])[:-1])
        top = np.argsort(-count, kind="stable")[:HEAD]
        top = top[count[top] > 0]
        n = len(back)
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "bucket": pa.array([*table.column("bucket").to_pylist(), table.column("bucket")[0].as_py()], pa.int32()),
            "counts": pa.array([*(_planes(x.astype("<u8")) for x in back), None], pa.binary()),
            "places": pa.array([*(_planes(x) for x in places), None], pa.binary()),
            "n": pa.array([None] * n + [in_band.tolist()], pa.list_(pa.int64())),
            "c": pa.array([None] * n + [np.bincount(band, count[known], BANDS).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "head": pa.array([None] * n + [[{"token": int(t), "count": int(k)} for t, k in zip(
                words[top].view(np.int64), count[top], strict=True)]], pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int64())]))),
        })

    return chunks.where("bucket >= 0").select("chunk", "bucket", "types", "seen").groupBy("bucket").applyInArrow(
        by_bucket, "chunk long, bucket int, counts binary, places binary, n array<long>, c array<long>, head array<struct<token: long, count: long>>")


def _most_frequent(counted: DataFrame, buckets: int) -> DataFrame:
    """The HEAD most frequent words (token, count): of the buckets' lists, merged in groups first."""

    def merged(table: pa.Table) -> pa.Table:
        flat = [x.flatten() for x in table.column("head").chunks]
        token, count = (np.concatenate([x.field(i).to_numpy() for x in flat]) for i in range(2))
        top = np.lexsort((token, -count))[:HEAD]
        return pa.table({"token": token[top], "count": count[top]})

    groups = math.isqrt(buckets) + 1
    lists = counted.where("chunk is null").select("head", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g"))
    return lists.groupBy("g").applyInArrow(merged, "token long, count long").orderBy(F.desc("count"), "token").limit(HEAD)


def _symbols(
    chunks: DataFrame, counted: DataFrame, head: np.ndarray, head_band: np.ndarray, before: np.ndarray, once: float, unseen: float,
    total: int, types: int,
) -> DataFrame:
    """Chunks with symbols for tokens, ranks for those outside the head, and for each document base score, known tokens and
    what the choice between words seen once and unseen adds to its log probability.

    head, head_band: the frequent words' hashes by symbol, and their bands. before: by bucket and band, the words of the
    buckets before. A word's rank is its number among the words of its band outside the head, in order of hashes.
    """
    words = chunks.where("bucket >= 0").select("chunk", "bucket", "types")
    joined = words.join(counted.where("chunk is not null").select("chunk", "bucket", "counts", "places"), ["chunk", "bucket"])
    order = np.argsort(head)
    ordered = head[order]
    head_of = {b: np.sort(head.view(U64)[head_band == b]) for b in np.unique(head_band).tolist()}

    def with_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ranks = [], []
            for types_, counts, places, bucket in zip(
                    *map(batch.column, ("types", "counts", "places", "bucket")), strict=True):
                token, count = np.frombuffer(types_.as_buffer(), np.int64), _unplanes(counts.as_py(), "<u8").astype(np.int64)
                band = _band(count)
                rank = before[bucket.as_py()][band] + _unplanes(places.as_py(), "<u4")
                for b, hashes in head_of.items():
                    at = np.flatnonzero(band == b)
                    rank[at] -= np.searchsorted(hashes, token[at].view(U64))
                symbol = HEAD + band
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, token), len(ordered) - 1)
                    symbol = np.where(ordered[at] == token, order[at], symbol)
                out.append(_planes(symbol.astype("<u2")))
                ranks.append(_planes(np.where((symbol >= HEAD) & (count > 0), rank, NONE).astype("<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("bucket"), batch.column("counts"), pa.array(out, pa.binary()),
                 pa.array(ranks, pa.binary())], names=["chunk", "bucket", "counts", "by_type", "ranks"])

    of_chunk = joined.mapInArrow(
        with_symbols, "chunk long, bucket int, counts binary, by_type binary, ranks binary").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "counts", "by_type", "ranks"))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                local = _unplanes(row["tokens"], "<u4")
                count = np.concatenate([_unplanes(w["counts"], "<u8") for w in row["words"]]).astype(np.int64)
                symbol = np.concatenate([_unplanes(w["by_type"], "<u2") for w in row["words"]])
                rank = np.concatenate([_unplanes(w["ranks"], "<u4") for w in row["words"]])
                sizes = np.array(row["sizes"])
                starts = np.cumsum(sizes) - sizes
                base = np.log10((count + 1) / (total + types + 1))
                inner = np.where(symbol == HEAD, np.where(count > 0, once, unseen), 0.0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["held_out"]], pa.list_(pa.bool_())),
                    pa.array([row["sizes"]], pa.list_(pa.int64())), pa.array([_planes(symbol[local])], pa.binary()),
                    pa.array([_planes(rank[local[symbol[local] >= HEAD]])], pa.binary()),
                    pa.array([np.add.reduceat(base[local], starts).tolist()]),
                    pa.array([np.add.reduceat((count > 0)[local].astype(np.int64), starts).tolist()]),
                    pa.array([np.add.reduceat(inner[local], starts).tolist()])], names=names)

    names = ["doc_ids", "held_out", "sizes", "symbols", "ranks", "base", "known", "inner"]
    documents = chunks.where("bucket < 0").select("chunk", "doc_ids", "held_out", "sizes", "tokens")
    return documents.join(of_chunk, "chunk").select("doc_ids", "held_out", "sizes", "tokens", "words").mapInArrow(
        run, "doc_ids array<long>, held_out array<boolean>, sizes array<long>, symbols binary, ranks binary, base array<double>, "
             "known array<long>, inner array<double>")


# The network.


def _nudge(table: np.ndarray, rows: np.ndarray, gradients: np.ndarray) -> None:
    """A gradient step on the rows of a table that `rows` names, each as often as it is visited."""
    if 8 * len(rows) < len(table):  # few visits: the rows they touch, not the whole table
        named, rows = np.unique(rows, return_inverse=True)
        part = table[named]
        _nudge(part, rows, gradients)
        table[named] = part
        return
    visits = np.bincount(rows, minlength=len(table))
    rate = ROW_RATE / (1 + visits / ROW_VISITS)
    for k in range(table.shape[1]):
        table[:, k] -= np.bincount(rows, gradients[:, k], len(table)) * rate


def _word_rows(band: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashed input rows of words outside the head."""
    key = mix((rank.astype(U64) << U64(6)) + band.astype(U64))
    return (key >> U64(64 - WORD_BITS)).astype(np.uint16), (key & U64((1 << WORD_BITS) - 1)).astype(np.uint16)


class Model:
    """Gated recurrent units over symbols. Weights are one float32 vector; the parts are views of it. The first `dense` are
    trained by Adam, the others are hashed rows. in_bands: the number of words outside the head, by band."""

    def __init__(self, settings: Settings, flat: np.ndarray | None = None, in_bands: np.ndarray | None = None):
        h = settings.hidden
        self.in_bands = np.zeros(BANDS, np.int64) if in_bands is None else in_bands.astype(np.int64)
        self.depth = np.array([max(int(n) - 1, 0).bit_length() for n in self.in_bands])
        shapes = {"embed": (SYMBOLS + 1, 3 * h), "recur": (h, 3 * h), "classes": (h, CLASSES), "class_bias": (CLASSES,),
                  "words": (HEAD_CLASSES, CLASS_WORDS, h), "word_bias": (HEAD_CLASSES, CLASS_WORDS),
                  "nodes": (1 << NODE_BITS, h + 1), "inputs": (1 << WORD_BITS, h)}
        self.dense = sum(int(np.prod(s)) for name, s in shapes.items() if name not in ("nodes", "inputs"))
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.h, self.flat = h, np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        at, self.parts = 0, {}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.parts[name] = self.flat[at:at + n].reshape(shape)
            at += n
        if flat is None:
            random = np.random.default_rng(settings.seed)
            for name, scale in (("embed", 0.3), ("recur", h ** -0.5), ("classes", 0.1), ("words", 0.1)):
                self.parts[name][:] = random.normal(0, scale, shapes[name])

    def start_at(self, head_counts: np.ndarray, band_counts: np.ndarray) -> None:
        """Output biases of a unigram model."""
        words = np.zeros(HEAD)
        words[:len(head_counts)] = head_counts
        words = words.reshape(HEAD_CLASSES, CLASS_WORDS) + 0.1
        self.parts["word_bias"][:] = np.log(words)
        self.parts["class_bias"][:] = np.log(np.r_[words.sum(1), band_counts + 0.1] / (words.sum() + band_counts.sum()))

    def forward(self, inputs: np.ndarray, ranks: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
        """inputs, their ranks, fresh: (steps, lanes). Hidden states (steps, lanes, h), the last state, what backward needs."""
        embed, recur, h = self.parts["embed"], self.parts["recur"], self.h
        own = ranks != NONE
        one, two = _word_rows(inputs[own] - HEAD, ranks[own])
        added = np.zeros((*inputs.shape, h), np.float32)
        added[own] = self.parts["inputs"][one] + self.parts["inputs"][two]
        out = np.empty((*inputs.shape, h), np.float32)
        kept = []
        for t in range(len(inputs)):
            before = state * ~fresh[t][:, None] if fresh[t].any() else state
            x = embed[inputs[t]]
            x[:, 2 * h:] += added[t]
            u = before @ recur
            gates = x[:, :2 * h] + u[:, :2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * u[:, 2 * h:])
            state = new + z * (before - new)
            out[t] = state
            if keep:
                kept.append((before, z, r, new, u[:, 2 * h:]))
        return out, state, kept

    def output(self, hidden: np.ndarray, targets: np.ndarray, grads: dict | None):
        """Natural log probabilities of the target symbols; with grads, adds to them and returns d hidden of the loss."""
        p = self.parts
        logits = hidden @ p["classes"] + p["class_bias"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        of_head = targets < HEAD
        cls = np.where(of_head, targets // CLASS_WORDS, targets - HEAD + HEAD_CLASSES)
        rows = np.arange(len(targets))
        logp = np.log(np.maximum(logits[rows, cls], 1e-30))
        if grads is not None:
            logits[rows, cls] -= 1
            grads["classes"] += hidden.T @ logits
            grads["class_bias"] += logits.sum(0)
            d_hidden = logits @ p["classes"].T
        by = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[by], np.arange(HEAD_CLASSES + 1))
        for k in range(HEAD_CLASSES):
            at = by[bounds[k]:bounds[k + 1]]
            if not len(at):
                continue
            inner = hidden[at] @ p["words"][k].T + p["word_bias"][k]
            inner -= inner.max(1, keepdims=True)
            np.exp(inner, out=inner)
            inner /= inner.sum(1, keepdims=True)
            mine = (np.arange(len(at)), targets[at] - k * CLASS_WORDS)
            logp[at] += np.log(np.maximum(inner[mine], 1e-30))
            if grads is not None:
                inner[mine] -= 1
                grads["words"][k] += inner.T @ hidden[at]
                grads["word_bias"][k] += inner.sum(0)
                d_hidden[at] += inner @ p["words"][k]
        return (logp, d_hidden) if grads is not None else logp

    def within(self, hidden: np.ndarray, band: np.ndarray, rank: np.ndarray, learn: bool):
        """Natural log probabilities of words within their bands; to learn, steps on the nodes' rows and returns d hidden too.

        The tree of n words halves ranges of ranks whose sizes are powers of two; a node without words on its right is none.
        """
        nodes = self.parts["nodes"]
        by = np.argsort(-self.depth[band], kind="stable")
        depth, n, r, at = self.depth[band][by], self.in_bands[band][by], rank[by].astype(np.int64), hidden[by]
        salt = band[by].astype(U64)
        logp, d_hidden = np.zeros(len(by), np.float32), np.zeros_like(at)
        rows, steps, done = np.empty(depth.sum(), np.uint16), np.empty((depth.sum(), self.h + 1), np.float32, "F"), 0
        for level in range(int(depth.max(initial=0))):
            k = int(np.searchsorted(-depth, -level, "left"))  # the words whose trees are deeper
            below = depth[:k] - level - 1
            side = r[:k] >> below
            middle = (side | 1) << below
            right, half = n[:k] - middle, 1 << below
            row = (mix((middle.astype(U64) << U64(6)) + salt[:k]) >> U64(64 - NODE_BITS)).astype(np.uint16)
            weights = nodes[row]
            odds = np.einsum("ij,ij->i", at[:k], weights[:, :-1]) + weights[:, -1]
            uneven = np.flatnonzero(right < half)
            if len(uneven):
                none = right[uneven] <= 0
                odds[uneven] += np.log(np.maximum(right[uneven], 1) / half[uneven]).astype(np.float32)
                odds[uneven[none]] = -80
            bit = (side & 1).astype(np.float32)
            small = np.exp(-np.abs(odds))
            logp[:k] -= np.log1p(small) + np.maximum(np.where(bit > 0, -odds, odds), 0)
            if learn:
                d = (np.where(odds > 0, 1, small) / (1 + small) - bit)[:, None]
                d_hidden[:k] += weights[:, :-1] * d
                rows[done:done + k] = row
                np.multiply(at[:k], d, out=steps[done:done + k, :-1])
                steps[done:done + k, -1] = d[:, 0]
                done += k
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        if not learn:
            return logp[back]
        _nudge(nodes, rows, steps)
        return logp[back], d_hidden[back]

    def backward(self, inputs, ranks, fresh, kept, d_out, grads) -> None:
        """Gradients of a window from those of its hidden states; truncated at its start. Steps on the words' input rows."""
        h, recur = self.h, self.parts["recur"]
        carry = np.zeros_like(d_out[0])
        d_x = np.empty((*inputs.shape, 3 * h), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, u_new = kept[t]
            d = d_out[t] + carry
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * u_new * r * (1 - r)
            d_x[t, :, :h], d_x[t, :, h:2 * h], d_x[t, :, 2 * h:] = d_z, d_r, d_new
            d_u = d_x[t].copy()
            d_u[:, 2 * h:] *= r
            grads["recur"] += before.T @ d_u
            carry = d_u @ recur.T + d * z
            if fresh[t].any():
                carry *= ~fresh[t][:, None]
        own = ranks != NONE
        one, two = _word_rows(inputs[own] - HEAD, ranks[own])
        d_own = np.clip(d_x[own][:, 2 * h:], -1, 1)
        _nudge(self.parts["inputs"], np.concatenate([one, two]), np.concatenate([d_own, d_own]))
        flat, rows = inputs.reshape(-1), d_x.reshape(-1, 3 * h)
        by = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0])
        grads["embed"][flat[by][heads]] += np.add.reduceat(rows[by], heads, axis=0)


@dataclass
class _Lanes:
    """Documents laid end to end in lanes, the longest lane first; step t has width[t] lanes.

    Tokens lie step after step, without room for lanes that have ended: one long document would make a rectangle of all
    lanes many times the tokens.
    """

    inputs: np.ndarray
    input_ranks: np.ndarray
    targets: np.ndarray
    ranks: np.ndarray
    fresh: np.ndarray
    owner: np.ndarray | None
    width: np.ndarray
    offset: np.ndarray  # of each step's tokens, and of the end

    def windows(self, settings: Settings) -> Iterator[tuple[np.ndarray, slice]]:
        """Which places (step, lane) of each window are tokens, and where these lie; the fewer lanes are left, the longer the
        window, as a step costs as much for few as for many."""
        t = 0
        while t < len(self.width):
            wide = int(self.width[t])
            stop = min(t + settings.window * min(max(settings.lanes // (4 * wide), 1), 16), len(self.width))
            yield np.arange(wide) < self.width[t:stop, None], slice(int(self.offset[t]), int(self.offset[stop]))
            t = stop

    def given(self, real: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, their ranks and starts of documents as (step, lane)."""
        inputs, ranks, fresh = np.full(real.shape, BEGIN, np.int32), np.full(real.shape, NONE, np.uint32), np.zeros(real.shape, bool)
        inputs[real], ranks[real], fresh[real] = self.inputs[part], self.input_ranks[part], self.fresh[part]
        return inputs, ranks, fresh


def _lanes(symbols: np.ndarray, ranks: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, lanes: int, owners: bool) -> _Lanes | None:
    """The chosen documents in at most `lanes` lanes of nearly equal length; whose token is where if `owners`."""
    if not len(chosen):
        return None
    starts = np.cumsum(sizes) - sizes
    chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]
    heap = [(0, k) for k in range(min(lanes, len(chosen)))]
    held: list[list[int]] = [[] for _ in heap]
    for doc in chosen.tolist():
        length, k = heapq.heappop(heap)
        held[k].append(doc)
        heapq.heappush(heap, (length + int(sizes[doc]), k))
    length = np.array([sum(int(sizes[d]) for d in docs) for docs in held])
    order = np.argsort(-length, kind="stable")
    width = np.searchsorted(np.sort(-length), -np.arange(int(length[order[0]])), "left")
    offset = np.r_[0, np.cumsum(width)]
    n_tokens = int(offset[-1])
    inputs, targets = np.full(n_tokens, BEGIN, np.uint16), np.zeros(n_tokens, np.uint16)
    input_ranks, laid_ranks = np.full(n_tokens, NONE, np.uint32), np.full(n_tokens, NONE, np.uint32)
    fresh, owner = np.zeros(n_tokens, bool), np.zeros(n_tokens, np.int32) if owners else None
    for column, k in enumerate(order.tolist()):
        at = 0
        for doc in held[k]:
            n = int(sizes[doc])
            text, own = symbols[starts[doc]:starts[doc] + n], ranks[starts[doc]:starts[doc] + n]
            place = offset[at:at + n] + column
            targets[place], inputs[place[1:]] = text, text[:-1]
            laid_ranks[place], input_ranks[place[1:]] = own, own[:-1]
            fresh[place[0]] = True
            if owners:
                owner[place] = doc
            at += n
    return _Lanes(inputs, input_ranks, targets, laid_ranks, fresh, owner, width, offset)


def train(model: Model, settings: Settings, chunks: Iterator[tuple[np.ndarray, ...]]) -> int:
    """Run over (symbols, ranks, sizes, chosen documents) chunks with Adam; the number of tokens learned from.

    Gradients add up until they are of half a full window's tokens, so the few lanes left at the end of a chunk, those of
    its longest document, weigh no more than others. What has gathered at the end is applied too, so that every token
    counted is one learned from.
    """
    dense = model.flat[:model.dense]
    first, second = np.zeros_like(dense), np.zeros_like(dense)
    step, tokens, gathered = 0, 0, 0
    gradient = Model(settings, np.zeros_like(model.flat))

    def apply() -> None:
        nonlocal step, gathered
        g = gradient.flat[:model.dense]
        g *= 1.0 / gathered
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g *= 1 / norm
        step += 1
        first[:] += 0.1 * (g - first)
        second[:] += 0.01 * (g * g - second)
        rate = settings.rate * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step)
        dense[:] -= np.float32(rate) * first / (np.sqrt(second) + np.float32(1e-8))
        gradient.flat[:], gathered = 0, 0

    for symbols, ranks, sizes, chosen in chunks:
        laid = _lanes(symbols, ranks, sizes, chosen, settings.lanes, owners=False)
        if laid is None:
            continue
        state = np.zeros((laid.width[0], model.h), np.float32)
        for real, part in laid.windows(settings):
            inputs, input_ranks, fresh = laid.given(real, part)
            hidden, state, kept = model.forward(inputs, input_ranks, fresh, state[:real.shape[1]], keep=True)
            at, targets, own = hidden[real], laid.targets[part].astype(np.int32), laid.ranks[part]
            _, d = model.output(at, targets, gradient.parts)
            tail = np.flatnonzero(own != NONE)
            d[tail] += model.within(at[tail], targets[tail] - HEAD, own[tail], learn=True)[1]
            d_hidden = np.zeros_like(hidden)
            d_hidden[real] = d
            model.backward(inputs, input_ranks, fresh, kept, d_hidden, gradient.parts)
            n = int(real.sum())
            tokens, gathered = tokens + n, gathered + n
            if 2 * gathered >= settings.lanes * settings.window:
                apply()
        # let go before the next chunks are put together
        del symbols, ranks, sizes, chosen, laid
    if gathered:
        apply()
    return tokens


def log_likelihood(model: Model, settings: Settings, symbols: np.ndarray, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's symbols and of the words within their bands, the state carried through all its windows."""
    out = np.zeros(len(sizes))
    laid = _lanes(symbols, ranks, sizes, np.arange(len(sizes)), 2 * settings.lanes, owners=True)
    if laid is None:
        return out
    state = np.zeros((laid.width[0], model.h), np.float32)
    for real, part in laid.windows(settings):
        hidden, state, _ = model.forward(*laid.given(real, part), state[:real.shape[1]], keep=False)
        at, targets, own = hidden[real], laid.targets[part].astype(np.int32), laid.ranks[part]
        logp = model.output(at, targets, None)
        tail = np.flatnonzero(own != NONE)
        logp[tail] += model.within(at[tail], targets[tail] - HEAD, own[tail], learn=False)
        out += np.bincount(laid.owner[part], logp.astype(np.float64), len(sizes))
    return out


def _average(weights: DataFrame) -> np.ndarray | None:
    """Mean by tokens of rows (part, tokens, weights), 16 at a time. What is averaged are changes, in half precision."""

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("tokens").to_numpy().astype(np.float64)
        total = np.zeros(len(table.column("weights")[0].as_buffer()) // 2)
        for w, x in zip(n, table.column("weights"), strict=True):
            total += w * np.frombuffer(x.as_buffer(), "<f2")
        return pa.table({"part": table.column("part")[:1], "tokens": pa.array([int(n.sum())]),
                         "weights": pa.array([(total / max(n.sum(), 1)).astype("<f2").tobytes()], pa.binary())})

    kind = "part long, tokens long, weights binary"
    while (many := weights.count()) > 1:
        groups = -(-many // 16)
        weights = staged(weights.groupBy(F.floor(F.col("part") / 16).alias("g")).applyInArrow(mean, kind), "weights")
        if groups == 1:
            break
        weights = weights.withColumn("part", F.floor(F.col("part") / 16))
    row = weights.first()
    return None if row is None else np.frombuffer(row["weights"], "<f2").astype(np.float32)


def score_documents(
    docs: DataFrame, settings: Settings = Settings(), folds: int = 7, held_fold: int = 2, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    buckets = 4 * shuffle_partitions(spark)
    chunks = staged(_chunks(wanted, buckets), "chunks")
    counted = staged(_counted(chunks), "counts")
    head = _most_frequent(counted, buckets).toPandas()
    sums = counted.where("chunk is null").select("bucket", "n", "c").collect()
    by_bucket = np.zeros((buckets, BANDS), np.int64)
    n, c = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
    for row in sums:
        by_bucket[row["bucket"]] = row["n"]
        n, c = n + row["n"], c + row["c"]
    before = np.cumsum(by_bucket, axis=0) - by_bucket
    total, types = int(c.sum()), int(n.sum())
    head_count = head["count"].to_numpy(np.int64)
    head_band = _band(head_count)
    n -= np.bincount(head_band, minlength=BANDS)
    c -= np.bincount(head_band, head_count, BANDS).astype(np.int64)
    # Next to each word seen once (weight 2) an unseen one (weight 1).
    once, unseen = (math.log10(2 / 3), -math.log10(3 * n[0])) if n[0] else (0.0, 0.0)
    ready = staged(_symbols(
        chunks, counted, head["token"].to_numpy(np.int64), head_band, before, once, unseen, total, types), "symbols")
    discard(chunks, counted)
    model = Model(settings)
    model.start_at(head_count, c)
    flat = model.flat
    for round_ in range(settings.rounds):
        change = _average(staged(_round(ready, settings, flat, n, round_), "weights"))
        flat = flat if change is None else flat + change
    return _scored(ready, settings, flat, n, int(total))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of chunks put together up to LAID_TOKENS."""

    def together(rows: list[dict]) -> dict:
        out = {c: np.concatenate([np.array(r[c]) for r in rows]) for c in rows[0] if c not in ("symbols", "ranks", "doc_ids")}
        out["symbols"] = np.concatenate([_unplanes(r["symbols"], "<u2").astype(np.int32) for r in rows])
        out["ranks"] = np.full(len(out["symbols"]), NONE, np.uint32)
        out["ranks"][out["symbols"] >= HEAD] = np.concatenate([_unplanes(r["ranks"], "<u4") for r in rows])
        out["doc_ids"] = [i for r in rows for i in r.get("doc_ids", ())]
        return out

    held, total = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(batch.slice(i, 1).to_pylist()[0])
            total += sum(held[-1]["sizes"])
            if total >= LAID_TOKENS:
                block, held, total = together(held), [], 0
                yield block
                del block
    if held:
        yield together(held)


def _round(ready: DataFrame, settings: Settings, flat: np.ndarray, in_bands: np.ndarray, round_: int) -> DataFrame:
    shared = ready.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def chunks():
            for row in _gathered(batches):
                chosen = np.flatnonzero(~row["held_out"].astype(bool))
                out = row["symbols"], row["ranks"], row["sizes"], chosen[round_::settings.rounds]
                del row, chosen
                yield out
                del out

        model = Model(settings, shared.value, in_bands)
        tokens = train(model, settings, chunks())
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([tokens], pa.int64()),
                 pa.array([(model.flat - shared.value).astype("<f2").tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    return ready.select("held_out", "sizes", "symbols", "ranks").mapInArrow(run, "part long, tokens long, weights binary")


def _scored(ready: DataFrame, settings: Settings, flat: np.ndarray, in_bands: np.ndarray, total: int) -> DataFrame:
    shared = ready.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(settings, shared.value, in_bands)
        for row in _gathered(batches):
            score = log_likelihood(model, settings, row["symbols"], row["ranks"], row["sizes"]) / np.log(10) + row["inner"]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"].astype(bool)), pa.array(row["sizes"]),
                pa.array(row["known"]), pa.array(np.full(len(score), total)), pa.array(row["base"]), pa.array(score),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del row, score

    return ready.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
