"""Vectorised views of Arrow text columns: bytes, words and rolling hashes.

Everything here works on one Arrow batch inside a task; Spark does the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text is handled alone, whole.
SLICE_BYTES = 2_000_000

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, U64)
    while len(have) < n:
        step = U64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in runs of at most `limit` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if wide == pa.large_binary() else "", wide))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def table(delimiters: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is the byte part of a word, the byte after lower-casing A-Z), by byte; delimiters are ASCII."""
    part = np.ones(256, bool)
    part[np.frombuffer(delimiters.encode(), np.uint8)] = False
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    return part, to


SPACES = " \t\n\x0b\x0c\r"
#: Everything in ASCII but digits and letters.
PUNCTUATION = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each data[start[i]:end[i]], none empty: every 8 bytes are mixed with their place, and all with the length.

    Sums of plain powers would not do: modulo 2 ** 64 some pairs of long words have equal sums for every odd base.
    """
    length = end - start
    if not len(length):
        return np.zeros(0, U64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)

    def block(at: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
        value = np.ascontiguousarray(eight[at]).view("<u8").reshape(-1)
        value &= U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(U64)
        return mix(value + place.astype(U64) * U64(BASE))

    total = block(start, length, np.ones(len(length), np.int64))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) >> 3
        first = np.cumsum(more) - more
        word = np.repeat(long, more)
        place = np.arange(len(word)) - np.repeat(first, more) + 1
        total[long] += np.add.reduceat(block(start[word] + 8 * place, length[word] - 8 * place, place + 1), first)
    return mix(total ^ mix(length.astype(U64) + U64(BASE)))


class Words:
    """Words of the texts of one slice.

    inside: is the byte part of a word; start, end: byte positions; first[i]..first[i + 1]: the words of text i; hash: 64 bits by content.
    """

    def __init__(self, column: pa.Array, delimiters: str = SPACES, lower: bool = True, kinds: np.ndarray | None = None):
        """kinds: by byte; a word also ends where a non-zero kind meets another non-zero kind."""
        part, to = table(delimiters, lower)
        data, self.offsets = raw(column)
        self.data = to[data] if lower else data
        n = len(data)
        inside = self.inside = part[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edges = self.offsets[self.offsets < n]
        before[edges] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        if kinds is not None:
            kind = kinds[data]
            turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
            before[turn + 1] = False
            after[turn] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    def shingles(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each run of `size` words within a text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        out = np.zeros(n, U64)
        for i in range(size):
            out = out * U64(BASE) + h[i:i + n]
        of = self.text_of
        at = np.flatnonzero(of[:n] == of[size - 1:])
        return mix(out[at]), at

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.start[word]:self.end[word]].tobytes()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])
