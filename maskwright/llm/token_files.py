"""Token-id files in a word-aligned code: each 64-bit word has a selector and as many ids as fit.

File: magic `SWORDS1\\n`, then blocks, then a directory and its place. A block holds `BLOCK_IDS` ids (the last one fewer);
the directory has for each block its first word and its number of ids, so blocks decode alone and in any order, many at
once. A word's top 4 bits select the layout of its lower 60 bits: (count, width). Selector 0 is the escape: the next word
is one id of 64 bits, whatever its size. Ids of a word lie from the low bits up.

Documents go to files in ascending id order: the table is range-partitioned by id and each task encodes, packs and
writes its range, sorted. The manifest (one row for each file) and the directory of documents are Spark tables; only
the attempt that Spark commits is in them, so files of lost tasks are never read.

Defined cases: null text is empty and gives the end id alone; a null id comes first; rows with one id stay next to each
other, in the order of their texts; other columns are not read; an empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import shared_folder, ship, staged
from .files import opened, task_file
from .texts import U64, Words, raw, slices, sums

MAGIC = b"SWORDS1\n"
BLOCK_IDS = 1 << 12
#: (ids in a word, bits of each) by selector; selector 0 is the escape.
LAYOUTS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
           (3, 20), (2, 30), (1, 60))
_DENSE_FIRST = range(1, len(LAYOUTS))


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 0 needs 1."""
    high = (ids >> U64(32)).astype(np.uint64)
    top = np.where(high > 0, high, ids).astype(np.float64)
    bits = np.frexp(top)[1].astype(np.int64)
    return np.maximum(np.where(high > 0, bits + 32, bits), 1)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of non-negative ids."""
    ids = ids.astype(U64)
    n = len(ids)
    starts = np.arange(0, n, BLOCK_IDS)
    if not n:
        return np.zeros(0, U64), starts
    width = _widths(ids)
    stop = np.minimum(np.arange(n) // BLOCK_IDS * BLOCK_IDS + BLOCK_IDS, n)
    choice = np.zeros(n, np.int8)
    for selector in reversed(_DENSE_FIRST):
        count, bits = LAYOUTS[selector]
        # The next place whose id is too wide; a word may run over its block's end, where it is filled with zeros.
        too_wide = np.where(width > bits, np.arange(n), n)
        ahead = np.minimum.accumulate(too_wide[::-1])[::-1]
        reach = np.minimum(np.arange(n) + count, stop)
        choice[ahead >= reach] = selector
    counts = np.array([c for c, _ in LAYOUTS])
    step = np.minimum(np.arange(n) + counts[choice], stop)
    # All blocks walk their words side by side.
    at, owner, places, owners = starts.copy(), np.arange(len(starts)), [], []
    ends = np.minimum(starts + BLOCK_IDS, n)
    while len(at):
        places.append(at)
        owners.append(owner)
        at = step[at]
        more = at < ends[owner]
        at, owner = at[more], owner[more]
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    selector = choice[place]
    escaped = selector == 0
    slot = np.arange(len(place)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(place) + int(escaped.sum()), U64)
    words[slot] = selector.astype(U64) << U64(60)
    words[slot[escaped] + 1] = ids[place[escaped]]
    for s in range(1, len(LAYOUTS)):
        count, bits = LAYOUTS[s]
        mine = np.flatnonzero(selector == s)
        if len(mine):
            source = place[mine, None] + np.arange(count)
            inside = source < stop[place[mine], None]
            values = np.where(inside, ids[np.minimum(source, n - 1)], U64(0)) << (np.arange(count, dtype=U64) * U64(bits))
            words[slot[mine]] |= np.bitwise_or.reduce(values, axis=1)
    return words, slot[np.searchsorted(owner, np.arange(len(starts)))]


def unpack(words: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks: `first` word of each and its number of ids; `words` ends with the last of them."""
    if not len(first):
        return np.zeros(0, U64)
    # Which words are escaped values: each follows an escape that is no value itself.
    selector = (words >> U64(60)).astype(np.int64)
    value = np.zeros(len(words), bool)
    ends = np.r_[first[1:], len(words)]
    for at in np.flatnonzero(selector == 0):
        if not value[at] and at + 1 < len(words):
            value[at + 1] = True
    lead = np.flatnonzero(~value)
    kind = selector[lead]
    size = np.array([c for c, _ in LAYOUTS])[kind]
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), U64)
    for s in range(len(LAYOUTS)):
        count, bits = LAYOUTS[s]
        mine = kind == s
        if not mine.any():
            continue
        if s == 0:
            out[start[mine]] = words[lead[mine] + 1]
        else:
            shift = np.arange(count, dtype=U64) * U64(bits)
            out[start[mine, None] + np.arange(count)] = (words[lead[mine], None] >> shift) & U64((1 << bits) - 1)
    # Blocks end within their last word: what fills it up goes.
    block = np.searchsorted(first, lead, "right") - 1
    held = np.bincount(block, size, len(first)).astype(np.int64)
    begin = np.cumsum(held) - held
    keep = np.arange(len(out)) - np.repeat(begin, held) < np.repeat(counts, held)
    assert len(ends) == len(first)
    return out[keep]


def write_file(uri: str, batches: Iterator[np.ndarray]) -> tuple[int, int]:
    """Write the ids; (number of ids, bytes). Memory: one batch and a block."""
    fs, path = opened(uri)
    directory, total, n_words = [], 0, 0
    with fs.open_output_stream(path) as out:
        out.write(MAGIC)

        def put(ids: np.ndarray) -> None:
            nonlocal total, n_words
            words, first = pack(ids)
            sizes = np.minimum(len(ids) - np.arange(0, len(ids), BLOCK_IDS), BLOCK_IDS)
            directory.append(np.stack([first + n_words, sizes], axis=1).astype("<u8"))
            out.write(words.astype("<u8").tobytes())
            total, n_words = total + len(ids), n_words + len(words)

        rest = np.zeros(0, U64)
        for ids in batches:
            rest = np.concatenate([rest, ids.astype(U64)])
            whole = len(rest) // BLOCK_IDS * BLOCK_IDS
            if whole:
                put(rest[:whole])
                rest = rest[whole:]
        if len(rest):
            put(rest)
        blocks = np.concatenate(directory) if directory else np.zeros((0, 2), "<u8")
        out.write(blocks.tobytes())
        out.write(struct.pack("<QQ", len(blocks), n_words))
        size = out.tell()
    return total, size


class TokenFile:
    """Reads any range of ids of a file by whole blocks."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self._in = fs.open_input_file(path)
        size = self._in.size()
        if self._in.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n, self._words = struct.unpack("<QQ", self._in.read_at(16, size - 16))
        blocks = np.frombuffer(self._in.read_at(16 * n, size - 16 - 16 * n), "<u8").reshape(n, 2).astype(np.int64)
        self._first, self._counts = blocks[:, 0], blocks[:, 1]

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, U64)
        a, b = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
        low = self._first[a]
        high = self._first[b] if b < len(self._first) else self._words
        words = np.frombuffer(self._in.read_at(8 * int(high - low), len(MAGIC) + 8 * int(low)), "<u8").astype(U64)
        ids = unpack(words, self._first[a:b] - low, self._counts[a:b])
        return ids[start - a * BLOCK_IDS:stop - a * BLOCK_IDS]

    def close(self) -> None:
        self._in.close()


_tokenizers: dict[str, tuple[object, dict[int, bytes]]] = {}
#: Pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 700_000
#: ASCII letters and digits are 1, punctuation but the apostrophe and what special tokens begin and end with is 2.
_KINDS = np.array([1 if chr(b).isalnum() else 2 if chr(b) in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~" else 0 for b in range(128)] + [0] * 128)


def _pieces(path: str):
    """A slice's texts -> (ids of all, number of ids of each), by pieces that the tokenizer encodes once each.

    Pieces end at blanks and line feeds and between ASCII letters or digits and punctuation. Right for tokenizers that
    lower their input, drop white space and join nothing across those places; other white space stays in its piece.
    """
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    tokenizer, known = _tokenizers[path]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Lower case could make a special token of what is none.
        plain = b"<|" not in raw(texts)[0].tobytes()
        words = Words(texts, " \n", lower=plain, kinds=_KINDS)
        pieces, where, each = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(known) > REMEMBERED:
            known.clear()
        keys = pieces.tolist() if plain else [(h,) for h in pieces.tolist()]
        new = [i for i, h in enumerate(keys) if h not in known]
        ask = [words.bytes_of(i).decode() for i in where[new].tolist()]
        for i, got in zip(new, tokenizer.encode_batch(ask, add_special_tokens=False), strict=True):
            known[keys[i]] = np.array(got.ids, "<u4").tobytes()
        found = [known[h] for h in keys]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(f) // 4 for f in found], np.int64)
        begin = np.cumsum(size) - size
        n = size[each]
        at = np.repeat(begin[each] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return ids[at], sums(n, words.first)

    return encode


def encode_to_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, files). documents: doc_id, part, at (ids before it in its file), n_tokens; files: part, uri, n_ids,
    bytes, before (ids in the files before it). `tokenizer` is a path that every executor has."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark) + "-tokens"
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _pieces(tokenizer)
        part = TaskContext.get().partitionId()
        uri = task_file(folder, "swords")
        rows: list[pa.RecordBatch] = []
        at = 0

        def ids() -> Iterator[np.ndarray]:
            nonlocal at
            for batch in batches:
                for some in slices(batch, "text"):
                    ids, n = encode(some.column("text"))
                    ends = np.cumsum(n)
                    rows.append(pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), pa.array(np.full(len(n), part, np.int32)),
                         pa.array(at + ends - n + np.arange(len(n))), pa.array(n + 1), pa.nulls(len(n), pa.string()),
                         pa.nulls(len(n), pa.int64())], names=names))
                    at += int(ends[-1]) + len(n)
                    yield np.insert(ids, ends, np.uint32(end_id))

        names = ["doc_id", "part", "at", "n_tokens", "uri", "bytes"]
        total, size = write_file(uri, ids())
        if rows:
            yield from rows
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, rows[0].column(0).type), pa.array([part], pa.int32()), pa.array([-1], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([uri]), pa.array([size], pa.int64())], names=names)

    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = wanted.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = wanted.schema["doc_id"].dataType.simpleString()
    both = staged(ordered.mapInArrow(
        run, f"doc_id {kind}, part int, at long, n_tokens long, uri string, bytes long"), "token-rows")
    files = both.where("at < 0").select("part", "uri", F.col("n_tokens").alias("n_ids"), "bytes").withColumn(
        "before", F.coalesce(F.sum("n_ids").over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return both.where("at >= 0").select("doc_id", "part", "at", "n_tokens"), files


def read_back(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            crc = []
            place = [batch.column(c).to_pylist() for c in ("uri", "at", "n_tokens")]
            starts = [0, *(i for i in range(1, batch.num_rows) if place[0][i] != place[0][i - 1] or i % 512 == 0), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if place[0][a] != uri:
                    if file:
                        file.close()
                    uri, file = place[0][a], TokenFile(place[0][a])
                low = place[1][a]
                ids = file.read(low, place[1][b - 1] + place[2][b - 1]).astype("<u4")
                crc += [zlib.crc32(ids[place[1][i] - low:place[1][i] - low + place[2][i]]) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if file:
            file.close()

    placed = documents.join(files.select("part", "uri", "before"), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "uri", "at")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return placed.sortWithinPartitions("uri", "at").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
