"""Removal of repeated passages by depth-limited radix passes over suffixes.

Two suffixes repeat a passage when they agree through their first `depth` bytes. The passes order them by ever more of
those bytes and drop what is alone in its group at once:

1. By one gram of `GRAM` bytes of the first `depth`: the one with the least hash, which equal windows have in common
   wherever they are. Neighbouring suffixes choose the same gram, so one entry stands for a run of them (about 25).
   Runs alone with their gram repeat nothing. Of runs whose whole bytes are equal all but the first are repeats.
2. By all `depth` bytes: the single suffixes of the runs that are left, the first of different runs with one gram.
   Equal groups are exactly the repeated windows; all but the first of a group are removed.

Entries go to their bucket packed, many to a row, and each task sends only its first of equal entries, so a passage that
all documents hold is one entry a task. Suffixes of a gram with many different runs are dealt by their own hash instead
of the gram's. Texts are joined twice, each time with the positions found so far.

Not every suffix is sorted from its first byte on: that takes 8 bytes and more of shuffle for each byte of text. The
result is the same, a window is removed if and only if its bytes start earlier elsewhere (hashes of 96 bits at least).

Defined cases: null is empty text; a null doc_id comes before all others; rows with one doc_id are one document
(told apart by 32 bits of their texts' hashes), and of two equal positions in it neither is earlier; texts under `depth` bytes keep all; matches never cross documents; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship, shuffle_partitions, staged
from .line_dedup import text_key
from .texts import BASE, BASE_INVERSE, U64, mix, powers, raw, slices

GRAM = 50
#: Different runs of one gram up to which its suffixes are compared in one place.
TOGETHER = 4096
#: Entries that a task packs before it sends them on.
PACKED = 1_500_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)

ENTRY = np.dtype([("core", "<u4"), ("whole", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "<u4")])
FOUND = "doc long, tag long, start long, n long, route long, state int"
REPEAT, OPEN = 1, 2


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    rest = width - k
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _runs(part: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket hash, entries): the runs of suffixes with one gram."""
    data, offsets = raw(part.column("text"))
    n = len(data)
    if n < depth:
        return np.zeros(0, U64), np.zeros(0, ENTRY)
    prefix = _prefix(data)
    at = np.arange(n - GRAM + 1)
    gram = _hash(prefix, at, at + GRAM)
    # The place is part of the value: the leftmost of equal hashes, and where it is.
    least = _least((gram >> U64(32) << U64(32)) | at.astype(U64), depth - GRAM + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(text[:n - depth + 1] == text[depth - 1:])
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, ENTRY)
    chosen = (least[first] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(chosen) != 0) | (np.diff(first) != 1)])
    start, stop = first[new], first[np.r_[new[1:], len(first)] - 1] + 1
    return _entries(part, gram[chosen[new]], _hash(prefix, start, stop - 1 + depth), text[start], start - offsets[text[start]], stop - start)


def _entries(part, core, whole, text, start, n) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(core), ENTRY)
    out["core"], out["whole"] = core & U64(0xFFFFFFFF), whole
    out["doc"] = part.column("doc").to_numpy()[text]
    out["tag"] = part.column("tag").to_numpy()[text]
    out["start"], out["n"] = start, n
    return core, out


def _windows(part: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket hash, entries): the single suffixes of the open runs. Two hashes of all bytes, 96 bits together."""
    data, offsets = raw(part.column("text"))
    prefix, second = _prefix(data), _prefix(data ^ np.uint8(0x5A))
    spans = part.column("open")
    counts = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    begin, n, route = (flat.field(i).to_numpy() for i in range(3))
    text = np.repeat(np.arange(len(counts)), counts)
    each = np.repeat(np.arange(len(n)), n)
    local = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    start = local + offsets[text[each]]
    whole = _hash(prefix, start, start + depth)
    core = _hash(second, start, start + depth)
    dealt = np.where(route[each] == 0, whole, route.view(U64)[each])
    _, out = _entries(part, core, whole, text[each], local, np.ones(len(each), np.uint32))
    return dealt, out


def _first_only(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, is the first of its group, group number by place in that order); groups are equal (core, whole)."""
    order = np.lexsort((entries["start"], entries["doc"], entries["whole"], entries["core"]))
    e = entries[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["core"][1:] != e["core"][:-1]) | (e["whole"][1:] != e["whole"][:-1])
    return order, new, np.cumsum(new) - 1


def _later(e: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of entries in group order: those that start after the group's first."""
    head = np.flatnonzero(new)[group] if len(e) else np.zeros(0, np.int64)
    return (e["doc"] != e["doc"][head]) | (e["start"] != e["start"][head])


def _found(e: np.ndarray, route: np.ndarray, state: int, depth: int) -> pa.RecordBatch:
    """Rows of FOUND; repeats that touch or overlap are one span of bytes."""
    if state == REPEAT and len(e):
        order = np.lexsort((e["start"], e["tag"], e["doc"]))
        e = e[order]
        stop = e["start"].astype(np.int64) + e["n"] + depth - 1
        fresh = np.r_[True, (e["doc"][1:] != e["doc"][:-1]) | (e["tag"][1:] != e["tag"][:-1])]
        # Within a text, stops rise with the starts but for runs inside others; a running maximum per text.
        shift = np.cumsum(fresh) * (1 << 33)
        reach = np.maximum.accumulate(stop + shift) - shift
        cut = np.flatnonzero(fresh | np.r_[True, e["start"][1:] > reach[:-1]])
        start, stop = e["start"][cut].astype(np.int64), reach[np.r_[cut[1:], len(e)] - 1]
        doc, tag, n, route = e["doc"][cut], e["tag"][cut], stop - start, np.zeros(len(cut), np.int64)
    else:
        doc, tag, start, n = e["doc"], e["tag"], e["start"].astype(np.int64), e["n"].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(tag.astype(np.int64)), pa.array(start), pa.array(n), pa.array(route.astype(np.int64)),
         pa.array(np.full(len(doc), state, np.int32))], names=["doc", "tag", "start", "n", "route", "state"])


def _pass(texts: DataFrame, split, depth: int, buckets: int) -> DataFrame:
    """One radix pass: entries to buckets, packed; then groups within each bucket. Rows of FOUND."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            dealt, entries = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, new, group = _first_only(entries)
            e, to = entries[order], (dealt[order] >> U64(33)).astype(np.int64) % buckets
            later = _later(e, new, group)
            yield from answer(_found(e[later], np.zeros(0), REPEAT, depth))
            keep = ~later
            e, to = e[keep], to[keep]
            by = np.argsort(to, kind="stable")
            e, to = e[by], to[by]
            cut = np.flatnonzero(np.r_[True, np.diff(to) != 0]) if len(to) else np.zeros(0, np.int64)
            rows = [(int(to[a]), _squeeze(e[a:b])) for a, b in zip(cut, np.r_[cut[1:], len(e)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "packed"])

        def answer(found: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            # What a task can already tell goes along as a row without a bucket's work to do.
            if found.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, found.schema) as out:
                    out.write_batch(found)
                spread = int(found.column("start")[0].as_py()) % buckets
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - spread], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["bucket", "packed"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(split(part, depth))
                if sum(len(x[0]) for x in held) > PACKED:
                    yield from send()
        if held:
            yield from send()

    def group(table: pa.Table) -> pa.Table:
        packed = table.column("packed")
        if table.column("bucket")[0].as_py() < 0:
            return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed])
        entries = np.concatenate([_spread(x.as_buffer()) for x in packed])
        order, new, groups = _first_only(entries)
        e = entries[order]
        later = _later(e, new, groups)
        done = [_found(e[later], np.zeros(0), REPEAT, depth)]
        if split is _runs:
            # Different runs of one gram: which of their suffixes are equal is not known yet.
            heads = np.flatnonzero(new)
            core = e["core"][heads]
            fresh = np.r_[True, core[1:] != core[:-1]]
            size = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1]
            left = e[~later]
            per = size[groups[~later]]
            left, per = left[per > 1], per[per > 1]
            route = np.where(per <= TOGETHER, mix(left["core"].astype(U64) + U64(1)).view(np.int64) | 1, 0)
            done.append(_found(left, route, OPEN, depth))
        return pa.Table.from_batches(done)

    return texts.mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInArrow(group, FOUND)


def _squeeze(e: np.ndarray) -> bytes:
    """Columns one after the other, so that the shuffle's compression finds the equal high bytes."""
    doc = np.diff(e["doc"], prepend=e["doc"][:1] * 0)
    return b"".join([
        np.array([len(e)], "<i8").tobytes(), e["core"].tobytes(), e["whole"].tobytes(),
        np.ascontiguousarray(doc.view(np.uint8).reshape(-1, 8).T).tobytes(),
        np.ascontiguousarray(e["tag"]).tobytes(),
        np.ascontiguousarray(np.ascontiguousarray(e["start"]).view(np.uint8).reshape(-1, 4).T).tobytes(),
        np.ascontiguousarray(np.ascontiguousarray(e["n"]).view(np.uint8).reshape(-1, 4).T).tobytes()])


def _spread(buffer: pa.Buffer) -> np.ndarray:
    view = np.frombuffer(buffer, np.uint8)
    n = int(view[:8].view("<i8")[0])
    out, at = np.zeros(n, ENTRY), 8
    for name, width, planes in (("core", 4, False), ("whole", 8, False), ("doc", 8, True), ("tag", 4, False), ("start", 4, True), ("n", 4, True)):
        part = view[at:at + n * width]
        if planes:
            part = np.ascontiguousarray(part.reshape(width, n).T).reshape(-1)
        kind = ENTRY.fields[name][0]
        values = np.frombuffer(part.tobytes(), kind)
        out[name] = np.cumsum(values) if name == "doc" else values
        at += n * width
    return out


def repeated_spans(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, spans [start, n bytes]) of each document with repeated bytes; spans may overlap."""
    if depth <= GRAM:
        raise ValueError(f"depth must exceed {GRAM} bytes")
    ship(docs.sparkSession)
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    first = staged(_pass(texts, _runs, depth, buckets), "runs")
    open_ = first.where(F.col("state") == OPEN).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "n", "route")).alias("open"))
    second = staged(_pass(texts.join(open_, ["doc", "tag"]), _windows, depth, buckets), "windows")
    return first.where(F.col("state") == REPEAT).unionByName(second).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.pmod(text_key(F.col(text_col)), F.lit(1 << 32)).alias("tag"), text.alias("text"))


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left), kept_sha256."""
    spans = repeated_spans(docs, depth, id_col, text_col)
    both = _keyed(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["doc", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                spans = part.column("spans").fill_null([])
                flat = spans.flatten()
                counts = np.diff(spans.offsets.to_numpy())
                base = np.repeat(offsets[:-1], counts)
                start = flat.field(0).to_numpy() + base
                depth_at = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth_at, start, 1)
                np.add.at(depth_at, start + flat.field(1).to_numpy(), -1)
                gone = np.cumsum(depth_at)[:-1] > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                edges = offsets[:-1][offsets[:-1] < len(data)]
                head[edges] = gone[edges]
                total = np.r_[0, np.cumsum(gone)]
                heads = np.r_[0, np.cumsum(head)]
                kept = [data[a:b][~gone[a:b]].tobytes() if c else data[a:b].tobytes()
                        for a, b, c in zip(offsets, offsets[1:], counts, strict=False)]
                doc = part.column("doc")
                yield pa.RecordBatch.from_arrays([
                    pc.if_else(pc.equal(doc, NO_ID), pa.scalar(None, pa.int64()), doc),
                    pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(heads[offsets])),
                    pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return both.select("doc", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
