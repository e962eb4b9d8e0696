"""Vector compression to codes of parts, with Drake-Hamerly adaptive bounds.

A vector's components become integers and it is cut into equal parts; each part position has a codebook, which a few rounds
of assigning and averaging make. Every distance that decides something is an integer.

The state of each part is a table, written once a round: the codes, and for each part its b closest entries with a lower
bound on the distance to each, in order, and one lower bound on the distance to all others. After the entries have moved,
a listed bound falls by how far its entry moved, the outer bound by how far any did. Only entries whose bound does not
exceed the distance to the entry of the last round are uncertain: those listed are compared by integer distances, ties to
the lower index; where the outer bound is uncertain too, all entries are, and the list is made anew. Bounds are floats that
are rounded so that they err on the side of a comparison. b is adapted from round to round by how many listed entries
were uncertain.

Tasks send sums and counts of each entry's parts; the driver sees the codebooks alone, which have a fixed number of entries.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left out; the vector of the
smallest vec_id sets the length, rows of another one, rows of a length that is no multiple of the parts, and rows with a
component so large that a sum of squares would not fit 62 bits keep a row with a null code and error; starts are of
distinct vec_ids, of several vectors of one id the smallest; a null vec_id is coded but is no start; fewer vectors than
entries make smaller codebooks; a table of null vec_ids alone starts from its smallest vector; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, ship, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Closest entries listed in the first round, at least and at most later.
LISTED, LEAST, MOST = 24, 4, 64
#: Bound of a place without an entry.
FAR = np.float32(1e30)
#: Rows compared at once.
ROWS = 2048


@dataclass
class Compressed:
    codes: DataFrame              # vec_id, label, code (hex), error; staged
    codebooks: list[np.ndarray]   # of each part: entries x components


def _down(x: np.ndarray) -> np.ndarray:
    """float32 below x, by more than the error of what made it."""
    return np.nextafter((x * (1 - 1e-9) - 1e-9).astype(np.float32), np.float32(-np.inf))


def _distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries; int64, exact."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    if 8 * most * most * max(parts.shape[1], 1) < 1 << 53:
        x, c = parts.astype(np.float64), book.astype(np.float64)  # every product and sum is an integer below 2 ** 53
    else:
        x, c = parts, book
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64)


class Bounds:
    """Codes, and the b closest entries with bounds, of one part position for the rows of a batch."""

    def __init__(self, code: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.code, self.near, self.lower, self.outer = code, near, lower, outer

    @classmethod
    def scan(cls, parts: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """Of all entries, and the squared distance to the nearest."""
        b = min(b, len(book))
        code, error = np.zeros(len(parts), np.uint8), np.zeros(len(parts), np.int64)
        near, lower, outer = np.zeros((len(parts), b), np.uint8), np.zeros((len(parts), b), np.float32), np.full(len(parts), np.inf, np.float32)
        for low in range(0, len(parts), ROWS):
            at = slice(low, low + ROWS)
            distance = _distances(parts[at], book)
            code[at] = distance.argmin(axis=1)  # the first of equal ones
            error[at] = distance.min(axis=1)
            order = np.argsort(distance, axis=1, kind="stable")
            ordered = np.take_along_axis(distance, order[:, :b + 1], axis=1)
            near[at] = order[:, :b]
            lower[at] = _down(np.sqrt(ordered[:, :b].astype(np.float64)))
            if b < len(book):
                outer[at] = _down(np.sqrt(ordered[:, b].astype(np.float64)))
        return cls(code, near, lower, outer), error

    def move(self, parts: np.ndarray, book: np.ndarray, drift: np.ndarray, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
        """After the entries moved by `drift`: the new state of b listed entries (the old number at most, unless compared
        with all), the squared distances, and by row how many listed entries were uncertain (-1: all entries)."""
        lower = _down(self.lower.astype(np.float64) - drift[self.near])
        outer = _down(self.outer.astype(np.float64) - drift.max(initial=0))
        chosen = book[self.code].astype(np.int64)
        own = ((parts - chosen) ** 2).sum(axis=1)
        reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-9
        uncertain = lower <= reach[:, None]
        anew = outer <= reach
        used = np.where(anew, -1, uncertain.sum(axis=1))
        code, error = self.code.astype(np.int64), own
        some, slot = np.nonzero(uncertain & ~anew[:, None])
        if len(some):
            entry = self.near[some, slot].astype(np.int64)
            exact = np.empty(len(some), np.int64)
            for low in range(0, len(some), 64 * ROWS):
                at = slice(low, low + 64 * ROWS)
                exact[at] = ((parts[some[at]] - book[entry[at]]) ** 2).sum(axis=1)
            lower[some, slot] = _down(np.sqrt(exact.astype(np.float64)))
            order = np.lexsort((entry, exact, some))
            first = order[np.r_[True, np.diff(some[order]) != 0]]
            rows = some[first]
            better = (exact[first] < error[rows]) | ((exact[first] == error[rows]) & (entry[first] < code[rows]))
            code[rows[better]], error[rows[better]] = entry[first[better]], exact[first[better]]
        # Lists stay in order; those beyond b go to the outer bound.
        order = np.argsort(lower, axis=1, kind="stable")
        near, lower = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(lower, order, axis=1)
        width = min(b, len(book))
        if near.shape[1] > width:
            outer = np.minimum(outer, lower[:, width])
        elif near.shape[1] < width:  # no entry is listed there
            more = width - near.shape[1]
            near = np.pad(near, ((0, 0), (0, more)))
            lower = np.pad(lower, ((0, 0), (0, more)), constant_values=FAR)
        state = Bounds(code.astype(np.uint8), near[:, :width].copy(), lower[:, :width].copy(), outer)
        at = np.flatnonzero(anew)
        if len(at):
            fresh, error[at] = Bounds.scan(parts[at], book, width)
            state.code[at], state.near[at], state.lower[at], state.outer[at] = fresh.code, fresh.near, fresh.lower, fresh.outer
        return state, error, used


def _fixed(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    """A binary column's values, of `shape` each."""
    data = b"".join(column.to_pylist())
    return (np.frombuffer(data, dtype) if data else np.zeros(0, dtype)).reshape(len(column), *shape)


def _rows(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    x = np.ascontiguousarray(x)
    width = x[0].nbytes if len(x) else 0
    data = x.tobytes()
    return pa.array([data[i * width:(i + 1) * width] for i in range(len(x))], pa.binary())


STATE = "vec_id {0}, label {1}, parts binary, codes binary, near binary, bounds binary, used binary, errors binary"


def _assigned(table: DataFrame, books: list[np.ndarray], drifts: list[np.ndarray] | None, listed: int, b: int) -> DataFrame:
    """The state of all rows after assigning them to the codebooks. listed: entries listed so far; drifts: None at first."""
    d, n = books[0].shape[1], len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _fixed(batch.column("parts"), "<i8", n, d)
            had = None if drifts is None else (
                _fixed(batch.column("codes"), np.uint8, n), _fixed(batch.column("near"), np.uint8, n, listed),
                _fixed(batch.column("bounds"), "<f4", n, listed + 1))
            states, errors, used = [], [], []
            for p, book in enumerate(books):
                if had is None:
                    state, error = Bounds.scan(parts[:, p], book, b)
                    count = np.full(len(parts), -1)
                else:
                    old = Bounds(had[0][:, p], had[1][:, p], had[2][:, p, :-1], had[2][:, p, -1])
                    state, error, count = old.move(parts[:, p], book, drifts[p], b)
                states.append(state)
                errors.append(error)
                used.append(count)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), batch.column("parts"),
                _rows(np.stack([s.code for s in states], axis=1)), _rows(np.stack([s.near for s in states], axis=1)),
                _rows(np.stack([np.column_stack([s.lower, s.outer]) for s in states], axis=1)),
                _rows(np.stack(used, axis=1).astype(np.int16)), _rows(np.stack(errors, axis=1))],
                names=["vec_id", "label", "parts", "codes", "near", "bounds", "used", "errors"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, STATE.format(kinds["vec_id"], kinds["label"]))


def _sums(state: DataFrame, n: int, d: int, entries: int) -> tuple[dict[tuple[int, int], tuple[int, list[int]]], np.ndarray]:
    """(part, entry) -> (count, sums of components), and how many parts had each number of uncertain listed entries.

    One row an entry and task meets in the aggregation; what comes to the driver is of the codebooks' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, seen = np.zeros((n, entries), np.int64), np.zeros((n, entries, d), np.int64), np.zeros(ENTRIES + 2, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _fixed(batch.column("parts"), "<i8", n, d)
            codes = _fixed(batch.column("codes"), np.uint8, n)
            used = _fixed(batch.column("used"), "<i2", n).ravel().astype(np.int64)
            seen += np.bincount(used + 1, minlength=len(seen))
            for p in range(n):
                order = np.argsort(codes[:, p], kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(codes[order, p].astype(np.int64)) != 0])
                entry = codes[order[start], p]
                count[p, entry] += np.diff(np.r_[start, len(order)])
                if d:
                    total[p, entry] += np.add.reduceat(parts[order, p], start, axis=0)
        part, entry = np.nonzero(count)
        rows = [(int(p), int(e), int(count[p, e]), total[p, e].tolist()) for p, e in zip(part, entry, strict=True)]
        rows += [(-1, int(k), int(seen[k]), []) for k in np.flatnonzero(seen)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    gathered = state.select("parts", "codes", "used").mapInArrow(run, "part int, entry int, n long, total array<long>")
    wide = [F.sum(F.get("total", F.lit(i)).cast("decimal(38, 0)")).alias(f"s{i}") for i in range(d)]
    sums, seen = {}, np.zeros(ENTRIES + 2, np.int64)
    for r in gathered.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        if r.part < 0:
            seen[r.entry] = r.n
        else:
            sums[r.part, r.entry] = r.n, [int(r[f"s{i}"]) for i in range(d)]
    return sums, seen


def next_listed(seen: np.ndarray, b: int) -> int:
    """Entries to list: those that nineteen of twenty lists needed, and a few more; more where many lists did not do."""
    lists = seen[1:].sum()
    if not lists:
        return b
    enough = int(np.searchsorted(np.cumsum(seen[1:]), 0.95 * lists)) + 2
    if seen[0] > 0.05 * (lists + seen[0]):
        enough = max(enough, 2 * b)
    return max(LEAST, min(enough, MOST))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> Compressed:
    """Codes of all vectors, and the codebooks that `rounds` rounds of assigning and averaging make."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    ship(spark)
    wanted = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    infinite = "x is null or isnan(x) or abs(x) = double('infinity')"
    kept = wanted.where(f"v is not null and not exists(v, x -> {infinite})")
    smallest = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(1).collect()
    kinds = dict(kept.dtypes)
    if not smallest:
        none = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
        return Compressed(staged(none, "codes"), [np.zeros((0, 0), np.int64)] * parts)
    length = len(smallest[0].v)
    # Distances of parts, and their sum over a vector, stay below 2 ** 62.
    most = math.isqrt((1 << 60) // max(length, 1))
    fits = f"size(v) = {length} and {length} % {parts} = 0 and not exists(v, x -> abs(x) >= {most / scale!r}D)"
    whole = f"transform(v, x -> cast(floor({scale} * x) as bigint))"
    rows = staged(kept.select("vec_id", "label", F.expr(f"case when {fits} then {whole} end").alias("x")), "integers")
    usable = rows.where("x is not null")
    ids = [r.vec_id for r in usable.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    named = usable.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x"))
    starts = [r.x for r in named.orderBy("vec_id").collect()]  # a fixed number
    starts = starts or [r.x for r in usable.orderBy("x").limit(1).collect()]
    unfit = rows.where("x is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not starts:
        return Compressed(staged(unfit, "codes"), [np.zeros((0, 0), np.int64)] * parts)
    d = length // parts
    first = np.array(starts, np.int64).reshape(len(starts), parts, d)
    books = [np.ascontiguousarray(first[:, p]) for p in range(parts)]

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, length)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _rows(x.astype("<i8"))], names=["vec_id", "label", "parts"])

    state = usable.mapInArrow(to_bytes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, parts binary")
    drifts, listed, b = None, 0, min(LISTED, len(starts))
    for turn in range(rounds + 1):
        after = staged(_assigned(state, books, drifts, listed, b), "state")
        if turn:
            discard(state)
        state, listed = after, b
        if turn == rounds:
            break
        sums, seen = _sums(state, parts, d, len(starts))
        moved = [book.copy() for book in books]
        for (p, e), (n, total) in sums.items():
            moved[p][e] = [s // n for s in total]
        drifts = [np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) for new, old in zip(moved, books, strict=True)]
        books, b = moved, min(next_listed(seen, b), len(starts))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                errors = _fixed(batch.column("errors"), "<i8", parts).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), batch.column("label"), pa.array([x.hex() for x in batch.column("codes").to_pylist()]),
                    pa.array(errors)], names=["vec_id", "label", "code", "error"])

    coded = state.select("vec_id", "label", "codes", "errors").mapInArrow(
        finish, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    codes = staged(coded.union(unfit), "codes")
    discard(rows, state)
    return Compressed(codes, books)


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Digest of all components as decimals, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_errors(done: Compressed) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels, nulls together), codebooks_sha256."""
    by_label = done.codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "l_label")
    return done.codes.join(by_label, F.expr("label <=> l_label")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(done.codebooks)).alias("codebooks_sha256"))
