"""Vector codes against plain rounds of assigning and averaging."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from maskwright.llm import codebooks as cb

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts int"


def reference(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    data = np.array([v for _, v, _ in kept], dtype=object).reshape(len(kept), parts, d)
    by_id = {}
    for i, v, _ in kept:
        if i is not None:
            by_id[i] = min(by_id.get(i, v), v)
    starts = np.array([by_id[i] for i in sorted(by_id)[:entries]], dtype=object).reshape(-1, parts, d)
    codes, errors = np.zeros((len(kept), parts), int), np.zeros(len(kept), object)
    books = []
    for p in range(parts):
        book = starts[:, p].copy()
        for turn in range(rounds + 1):
            distance = ((data[:, p][:, None] - book[None]) ** 2).sum(axis=2)
            codes[:, p] = [min(range(len(book)), key=lambda e, r=row: (r[e], e)) for row in distance]
            if turn < rounds:
                for e in set(codes[:, p].tolist()):
                    mine = data[codes[:, p] == e, p]
                    book[e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
        errors += distance[np.arange(len(kept)), codes[:, p]]
        books.append(book)
    sha = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    by_label = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    return [(i, "".join(f"{c:02x}" for c in row), int(error), int(by_label[label]), sha)
            for (i, _, label), row, error in zip(kept, codes, errors, strict=True)]


def vectors(n, length, seed, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(length)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.2 * scale) for x in rng.choice(centres)]
        rows.append((i * 2 + 1, v, rng.choice([None, 1, 2, 3])))
    rows += [(7, rows[5][1], 1), (9, rows[4][1], 2), (9, rows[4][1], 2), (None, rows[3][1], 3), (10_001, None, 1)]  # repeated ids and vectors
    rows += [(10_003, [None] * length, 1), (10_005, [float("nan")] * length, 1), (10_007, [float("inf")] + [0.0] * (length - 1), 1)]
    rows += [(20_001 + i, [0.5] * length, None) for i in range(40)]  # ties
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "entries", "rounds", "scale", "listed"), [(400, 256, 4, 0.1, 24), (300, 20, 6, 1.0, 5), (6, 256, 2, 30.0, 24), (200, 32, 5, 20_000.0, 3)])
def test_codes(spark, monkeypatch, n, entries, rounds, scale, listed):
    monkeypatch.setattr(cb, "LISTED", listed)
    rows = vectors(n, 8, n, scale)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in cb.with_label_errors(cb.compress(frame, entries=entries, rounds=rounds)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, reference(rows, 4, entries, rounds)))


def test_odd_vectors(spark):
    assert cb.with_label_errors(cb.compress(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, [1.0] * 8, 1, "c", 1), (2, [1.0] * 7, 1, "c", 1), (3, [], 1, "c", 1), (4, [1e30] * 8, 1, "c", 1), (5, [1.5] * 8, None, "c", 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in cb.with_label_errors(cb.compress(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: (None, None, 0), 5: ("01010101", 0, 0)}
    for length, code in ((0, "00000000"), (6, None)):
        frame = spark.createDataFrame([(i, [0.5] * length, 1, "c", 1) for i in (1, 2, None)], SCHEMA)
        assert {r.code for r in cb.compress(frame).codes.collect()} == {code}


def test_bounds_hold_while_entries_move():
    """Every bound stays below the true distance, and most rows are decided without looking at all entries."""
    rng = np.random.default_rng(1)
    parts = rng.integers(-300, 300, (3000, 6))
    book = parts[:64].copy()
    state, _ = cb.Bounds.scan(parts, book, 16)
    scans = 0
    for turn, b in enumerate((16, 9, 12, 5)):
        new = book + rng.integers(-6, 7, book.shape)
        drift = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + 1e-9)
        state, error, used = state.move(parts, new, drift, b)
        book = new
        distance = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (state.code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
        true = np.sqrt(distance)
        real = state.lower < 1e20  # others are places without an entry
        assert (state.lower <= np.take_along_axis(true, state.near.astype(int), axis=1))[real].all()
        listed = np.zeros(true.shape, bool)
        rows, slots = np.nonzero(real)
        listed[rows, state.near[rows, slots]] = True
        assert (np.where(listed, np.inf, true).min(axis=1) >= state.outer).all()
        assert (np.diff(state.lower, axis=1) >= 0).all() or (used == -1).any()
        scans += (used == -1).mean()
    assert scans < 2
