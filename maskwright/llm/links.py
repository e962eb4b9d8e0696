"""Similarity links among candidates: which sets that share a key are as similar as asked, as far as components need it.

Candidates come as (key, node) rows; which pairs share a key is the caller's method. A sketch of each set bounds the
similarity of two sets from above, so a pair whose sketches are too far apart is no link for sure. As only components are
asked for, no two nodes known to be connected are ever compared again:

1. every node against the smallest node it shares a key with, on the full sets;
2. in each key, the pairs of different components whose sketches are near; components that such pairs connect, and so
   all nodes that may still be linked, fall into one cluster. Of those that a task connects it tells a star alone, each
   with the least that it reaches;
3. each cluster in pairs of blocks, with the sets: all its near pairs in different components are confirmed on the full
   sets, in the task, which returns only links that join what it has not joined yet.

After 3 every near pair that shares a key is confirmed, refused, or connected anyhow. Keys and clusters with many nodes are
dealt out as pairs of blocks, so no task holds more than two blocks and nothing is capped; blocks of one large component
are not paired with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, staged
from .components import components

#: Nodes in a block of a key or cluster with many, and the elements of their sets.
BLOCK = 256
BLOCK_ELEMENTS = 1 << 20

#: Of the sketches of some rows: a function of one row of each pair and the other, which pairs may be as similar as asked.
Near = Callable[[pa.ChunkedArray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def streamed(rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """work(table) on whole groups of `by`, several small ones at once, in one pass over sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # All but the last group of what has come is whole.
            last = [batch.column(c)[-1].as_py() for c in by]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(by, last, strict=True)])
            start = int(np.argmax(same))
            if held and (start or [held[-1].column(c)[-1].as_py() for c in by] != last):
                yield work(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            elif start:
                yield work(pa.Table.from_batches([batch.slice(0, start)]))
            held.append(batch.slice(start))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, schema)


def _in_block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, node, label, size, ...) once for each pair of blocks that their block is in: with a column `pair`.

    Blocks hold part of one large component, or many small ones.
    """
    many = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("elements") / BLOCK_ELEMENTS)).cast("int")
    of_label = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum("size").alias("elements"))
    large = (F.col("n") > BLOCK // 2) | (F.col("elements") > BLOCK_ELEMENTS // 2)
    shared = of_label.where(~large).groupBy(group).agg(many.alias("n_shared"))
    own = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS))
    placed = of_label.join(shared, group, "left").select(
        group, "label", F.when(large, F.col("label")).alias("own"),
        F.when(large, own).otherwise(F.col("n_shared")).cast("int").alias("many"))
    blocks = placed.select(group, "own", "many").distinct().select(
        group, "own", F.explode(F.expr("sequence(0, many - 1)")).alias("block"))
    one, two = blocks.alias("p"), blocks.alias("q")
    code = "struct({0}.own is not null, {0}.own, {0}.block)"
    pairs = one.join(two, F.expr(f"p.{group} = q.{group} and not (p.own is not null and p.own <=> q.own)")).where(
        F.expr(f"{code.format('p')} <= {code.format('q')}"))
    pairs = pairs.select(
        F.col(f"p.{group}").alias(group), F.expr("xxhash64(p.own, p.block, q.own, q.block)").alias("pair"),
        F.explode(F.expr("array_distinct(array(struct(p.own, p.block), struct(q.own, q.block)))")).alias("x")
    ).select(group, "pair", "x.own", "x.block").alias("r")
    located = rows.join(placed, [group, "label"]).withColumn("block", F.expr(
        "cast(pmod(if(own is null, xxhash64(label), xxhash64(node)), many) as int)")).alias("m")
    return located.join(pairs, F.expr(f"m.{group} = r.{group} and m.own <=> r.own and m.block = r.block")).select(
        *[f"m.{c}" for c in rows.columns], "r.pair")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each place below n reaches by the pairs."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array(parent, np.int64)
    while len(roots) and (roots[roots] != roots).any():
        roots = roots[roots]
    return roots


def _near_stars(members: DataFrame, near: Near) -> DataFrame:
    """Stars (a, b) of the labels that near pairs of a key connect: each with the least one that it reaches in its task.

    members: key, node, label, size, sketch.
    """

    def work(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        key, pair = (rows.column(c).to_numpy() for c in ("key", "pair"))
        labels, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        close = near(rows.column("sketch"))
        found, at, step = [], np.arange(n), 0
        while True:
            step += 1
            at = at[at + step < n]
            at = at[(key[at] == key[at + step]) & (pair[at] == pair[at + step])]
            if not len(at):
                break
            a = at[label[at] != label[at + step]]
            a = a[close(a, a + step)]
            found.append(np.unique(np.stack([label[a], label[a + step]]), axis=1))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        roots = _roots(a, b, len(labels))
        out = np.flatnonzero(roots != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(labels[roots[out]]), pa.array(labels[out])], names=["a", "b"])

    return streamed(_in_block_pairs(members, "key"), ["key", "pair"], work, "a long, b long").distinct()


def with_partners(members: DataFrame, sketches: DataFrame, near: Near) -> DataFrame:
    """key, node, leader of the members (key, node) that may have a link in their key. The table is staged.

    In a key of a block at most every pair of sketches is looked at, and nodes near no other are dropped; larger keys stay
    whole. sketches: node, sketch.
    """

    def work(rows: pa.Table) -> pa.RecordBatch:
        n, key, node = rows.num_rows, rows.column("key").to_numpy(), rows.column("node").to_numpy()
        close = near(rows.column("sketch"))
        kept, at, step = np.zeros(n, bool), np.arange(n), 0
        while True:
            step += 1
            at = at[at + step < n]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            found = at[close(at, at + step)]
            kept[found] = kept[found + step] = True
        return pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept])], names=["key", "node"])

    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = members.join(sizes, "key")
    small = streamed(sized.where(F.col("n") <= BLOCK).drop("n").join(sketches, "node"), ["key"], work, "key long, node long")
    left = staged(small.union(sized.where(F.col("n") > BLOCK).select("key", "node")), "left")
    leaders = left.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader < most")
    found = staged(left.join(leaders.select("key", "leader"), "key").select("key", "node", "leader"), "members")
    discard(left)
    return found


def _confirmed_in_clusters(members: DataFrame, near: Near, percent: int) -> DataFrame:
    """Links (a, b) on the full sets that join the components of each cluster.

    members: cluster, node, label, size, sketch, elements.
    """

    def work(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        cluster, pair, node, label = (rows.column(c).to_numpy() for c in ("cluster", "pair", "node", "label"))
        close = near(rows.column("sketch"))
        sets = rows.column("elements").chunk(0)
        offsets = sets.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        _, element = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        size = np.diff(offsets)
        mark = np.zeros(int(element.max(initial=0)) + 1, bool)
        cut = np.flatnonzero(np.r_[True, (np.diff(cluster) != 0) | (np.diff(pair) != 0)])
        links = []
        for low, high in zip(cut, np.r_[cut[1:], len(node)], strict=True):
            _, joined = np.unique(label[low:high], return_inverse=True)  # the component of each, as joined so far
            for x in range(low, high - 1):
                y = np.flatnonzero(joined[x - low + 1:] != joined[x - low]) + x + 1
                y = y[close(np.full(len(y), x), y)]
                if not len(y):
                    continue
                mark[element[offsets[x]:offsets[x + 1]]] = True
                # The sets of all y, one after the other.
                begin = np.cumsum(size[y]) - size[y]
                flat = element[np.arange(int(size[y].sum())) + np.repeat(offsets[y] - begin, size[y])]
                common = np.add.reduceat(mark[flat].astype(np.int64), begin)
                mark[element[offsets[x]:offsets[x + 1]]] = False
                for other in y[100 * common >= percent * (size[x] + size[y] - common)].tolist():
                    if joined[other - low] != joined[x - low]:
                        links.append((node[x], node[other]))
                        joined[joined == joined[other - low]] = joined[x - low]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return streamed(_in_block_pairs(members, "cluster"), ["cluster", "pair"], work, "a long, b long")


def linked(members: DataFrame, sets: DataFrame, near: Near, percent: int) -> DataFrame:
    """(node, label): the component of each node with a link; label is its smallest node. The table is staged.

    members: key, node, leader (the least node of the key), two nodes a key at least. sets: node, size, sketch, elements
    (no element twice) of every node in members; a node with several sets has the links of each.
    """

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")

    first = members.where("node <> leader").groupBy("node").agg(F.min("leader").alias("a")).select(
        "a", F.col("node").alias("b"))
    links = staged(confirmed(first), "confirmed")
    before = components(links)
    labelled = members.select("key", "node").join(before, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m")
    rest = staged(labelled.join(open_keys.select("key"), "key", "left_semi"), "open")
    clusters = components(_near_stars(rest.join(sets.select("node", "size", "sketch"), "node"), near))
    within = clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")).join(
        rest.select("node", "label").distinct(), "label").join(sets.select("node", "size", "sketch", "elements"), "node")
    more = staged(_confirmed_in_clusters(within, near, percent), "confirmed")
    labels = components(links.union(more))
    discard(links, before, rest, clusters, more)
    return labels
