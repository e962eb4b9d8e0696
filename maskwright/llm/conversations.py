"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation is its rows by turn. Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated
(does not end a sentence). Edits make the roles' initials `(s?(ua)+)?`: Keep is free, Rerole to user or assistant costs 2,
Delete 3 (blank and duplicate rows must go), Insert of an empty user or assistant message 2; a truncated row that stays
costs 1 more. The audit is the edits' initials in order; of the cheapest the least in ASCII order is chosen.

The lattice's nodes are (rows done, state of the pattern). One heap runs forward from the start and one in reverse from the
ends, in order of cost, and by rows among equal costs, so that a label is final when its node is settled: its least
cost, and of equal costs the least audit (two audits of equal cost through the same rows are never one the beginning of
the other, as inserts cost something). The search goes on until no cheaper crossing and none of equal cost is left; the
least concatenated audit over all crossings is the answer.

A conversation of many rows is searched in chunks: for each state at a chunk's first row and each after its last one the
cheapest edits, with inserts before rows only. Chunks are joined `FAN` at a time by the same search over a lattice whose
edges are the chunks' answers, level by level, and the states chosen at the top are handed down again. So no task holds
more than a chunk of rows, or `FAN` answers. A conversation's rows are numbered by range partitions, and the digest of a
repaired conversation is taken in one pass over its sorted messages.

Defined cases: null role or text is one space; null turns come first; rows of one turn are ordered by role, then text;
equal rows are duplicates; a null conversation id is a conversation of its own; roles of other initials can be kept in
no place; a conversation without rows has an empty repair; gaps beyond 64 bits are null; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import discard, ship, staged

SPACES = " \t\n\x0b\x0c\r"
CHUNK = 512
FAN = 512
#: State after a message of the initial: 0 nothing yet, 1 after the system's, 2 after a user's, 3 after an assistant's.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: Cheapest inserts that end a conversation, by state.
ENDS = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
ROLES = {"u": "user", "a": "assistant"}
MOVE = "struct<p:int,q:int,cost:bigint,audit:string,trail:string>"


# --- the search --------------------------------------------------------------

Edge = tuple[int, str, int, int]  # cost, audit, level and state after it


def row_edges(facts: str) -> dict[tuple[int, int], list[Edge]]:
    """Edits of rows; facts: two characters a row, the role's initial (s, u, a, x) and its fault (b, d, t, or k for none)."""
    out = {}
    for i in range(len(facts) // 2):
        initial, fault = facts[2 * i], facts[2 * i + 1]
        for state, after in NEXT.items():
            edges = [(3, "D", i + 1, state)]
            if fault in "tk":
                late = int(fault == "t")
                if initial in after:
                    edges.append((late, "K", i + 1, after[initial]))
                edges += [(2 + late, "R", i + 1, after[role]) for role in ROLES if role in after]
            edges += [(2, "I", i, after[role]) for role in ROLES if role in after]
            out[i, state] = edges
    return out


def segment_edges(segments: list[list[dict]]) -> dict[tuple[int, int], list[Edge]]:
    """The answers of neighbouring segments as edges."""
    out = defaultdict(list)
    for i, moves in enumerate(segments):
        for m in moves:
            out[i, m["p"]].append((m["cost"], m["audit"], i + 1, m["q"]))
    return out


def reversed_edges(edges: dict[tuple[int, int], list[Edge]]) -> dict[tuple[int, int], list[Edge]]:
    out = defaultdict(list)
    for (i, s), each in edges.items():
        for cost, audit, j, t in each:
            out[j, t].append((cost, audit, i, s))
    return out


def cheapest(forward, reverse, n: int, start: int, ends: dict[int, tuple[int, str]]) -> tuple[int, str, str] | None:
    """(cost, audit, states after each edge) from (0, start) to the states after n, each with a last edge of its own to the end."""
    forward = {**forward, **{(n, q): [(cost, audit, n + 1, 0)] for q, (cost, audit) in ends.items()}}
    reverse = {**reverse, (n + 1, 0): [(cost, audit, n, q) for q, (cost, audit) in ends.items()]}
    ahead, back = {(0, start): (0, "", "")}, {(n + 1, 0): (0, "", "")}
    heap, reverse_heap = [(0, 0, start)], [(0, -n - 1, 0)]
    settled, reverse_settled = {}, {}
    best = float("inf")
    while heap or reverse_heap:
        f, b = heap[0][0] if heap else None, reverse_heap[0][0] if reverse_heap else None
        if (f or 0) + (b or 0) > best:
            break
        if b is None or (f is not None and f <= b):
            _, i, s = heapq.heappop(heap)
            if (i, s) in settled:
                continue
            cost, audit, trail = settled[i, s] = ahead[i, s]
            if (i, s) in reverse_settled:
                best = min(best, cost + reverse_settled[i, s][0])
            for more, edit, j, t in forward.get((i, s), ()):
                label, had = (cost + more, audit + edit, trail + str(t)), ahead.get((j, t))
                if had is None or label < had:
                    ahead[j, t] = label
                    if had is None or label[0] < had[0]:
                        heapq.heappush(heap, (label[0], j, t))
                if (j, t) in reverse_settled:
                    best = min(best, label[0] + reverse_settled[j, t][0])
        else:
            _, i, s = heapq.heappop(reverse_heap)
            i = -i
            if (i, s) in reverse_settled:
                continue
            cost, audit, trail = reverse_settled[i, s] = back[i, s]
            if (i, s) in settled:
                best = min(best, cost + settled[i, s][0])
            for more, edit, j, t in reverse.get((i, s), ()):
                label, had = (cost + more, edit + audit, str(s) + trail), back.get((j, t))
                if had is None or label < had:
                    back[j, t] = label
                    if had is None or label[0] < had[0]:
                        heapq.heappush(reverse_heap, (label[0], -j, t))
                if (j, t) in settled:
                    best = min(best, label[0] + settled[j, t][0])
    if best == float("inf"):
        return None
    # Every cheapest way has a settled node whose next one is settled in reverse, or a node that is both.
    found = []
    for node, (cost, audit, trail) in settled.items():
        if node in reverse_settled and cost + reverse_settled[node][0] == best:
            found.append((audit + reverse_settled[node][1], trail + reverse_settled[node][2]))
        for more, edit, j, t in forward.get(node, ()):
            rest = reverse_settled.get((j, t))
            if rest is not None and cost + more + rest[0] == best:
                found.append((audit + edit + rest[1], trail + str(t) + rest[2]))
    audit, trail = min(found)
    return best, audit, trail[:-1]


def moves(edges: dict[tuple[int, int], list[Edge]], n: int) -> list[dict]:
    """The cheapest edits from each state before to each state after n rows or segments."""
    reverse, out = reversed_edges(edges), []
    for p in NEXT:
        for q in NEXT:
            found = cheapest(edges, reverse, n, p, {q: (0, "")})
            if found:
                out.append({"p": p, "q": q, "cost": found[0], "audit": found[1], "trail": found[2]})
    return out


def apply(facts: str, state: int, audit: str) -> list[tuple[int | None, str, str | None]]:
    """(row, edit, new role) of each message that an audit leaves, in order; row is None for inserts, role for rows kept."""
    out, row = [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        initial = facts[2 * row] if state == 0 and edit == "K" else "a" if state == 2 else "u"
        state = NEXT[state][initial]
        out.append((None if edit == "I" else row, edit, None if edit == "K" else ROLES[initial]))
        row += edit != "I"
    return out


# --- on tables ---------------------------------------------------------------

def placed(turns: DataFrame) -> DataFrame:
    """conv_id, nr (0 for the first row of its conversation), role, text; numbered by range partitions, staged."""
    head = F.substring("text", 1, 64)
    ranged = turns.withColumn("head", head).repartitionByRange("conv_id", "turn", "role", "head")
    at = staged(ranged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "placed")
    by_part = at.withColumn("partition", F.shiftright("at", 33))
    starts = by_part.groupBy("conv_id", "partition").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("conv_id").alias("s_conv"), F.col("partition").alias("s_part"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = staged(by_part.join(starts, F.expr("conv_id <=> s_conv and partition = s_part")).select(
        "conv_id", "turn", (F.col("before") + F.col("at") - F.col("first")).alias("nr"), "role", "text"), "rows")
    discard(at)
    return numbered


def with_facts(rows: DataFrame) -> DataFrame:
    """rows with `initial` and `fault`. Copies meet as counts of their digests, never as rows of one group."""
    ending = F.rtrim(F.col("text"), F.lit(SPACES))
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("sha")).agg(F.min("nr").alias("f_nr")).select(
        F.col("conv_id").alias("f_conv"), "f_nr")
    letter = F.substring("role", 1, 1)
    fault = F.when(ending == "", "b").when(F.col("f_nr").isNull(), "d").when(
        ~F.substring(ending, -1, 1).isin(".", "!", "?"), "t").otherwise("k")
    return rows.join(first, F.expr("conv_id <=> f_conv and nr = f_nr"), "left").select(
        *rows.columns, F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("initial"), fault.alias("fault"))


def _searched(chunks: DataFrame, chunk: int) -> DataFrame:
    """conv_id, idx, facts, whole, moves of chunks; a whole conversation has one move, to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, wholes = [], []
            for idx, facts in zip(batch.column("idx").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                edges, n = row_edges(facts), len(facts) // 2
                wholes.append(idx == 0 and n < chunk)
                if wholes[-1]:
                    cost, audit, _ = cheapest(edges, reversed_edges(edges), n, 0, ENDS)
                    found.append([{"p": 0, "q": 0, "cost": cost, "audit": audit, "trail": ""}])
                else:
                    found.append([m | {"trail": ""} for m in moves(edges, n)])
            yield _record(batch, {"whole": pa.array(wholes, pa.bool_()), "moves": _moves_array(found)}, ("conv_id", "idx", "facts"))

    kind = dict(chunks.dtypes)["conv_id"]
    return chunks.select("conv_id", "idx", "facts").mapInArrow(
        run, f"conv_id {kind}, idx long, facts string, whole boolean, moves array<{MOVE}>")


_MOVES = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("trail", pa.string())]))


def _moves_array(found: list[list[dict]]) -> pa.Array:
    return pa.array(found, _MOVES)


def _record(batch: pa.RecordBatch, more: dict[str, pa.Array], kept: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more.values()], names=[*kept, *more])


def _merged(segments: DataFrame, fan: int) -> DataFrame:
    """conv_id, idx, moves: `fan` neighbouring segments as one, whose trail has the state after each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [moves(segment_edges([s["moves"] for s in each]), len(each)) for each in batch.column("parts").to_pylist()]
            yield _record(batch, {"moves": _moves_array(found)}, ("conv_id", "idx"))

    kind = dict(segments.dtypes)["conv_id"]
    grouped = segments.groupBy("conv_id", F.expr(f"idx div {fan}").alias("above")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "moves"))).alias("parts"))
    return grouped.select("conv_id", F.col("above").alias("idx"), "parts").mapInArrow(
        run, f"conv_id {kind}, idx long, moves array<{MOVE}>")


def _chosen_moves(chosen: DataFrame, segments: DataFrame) -> DataFrame:
    """The move (p, q) that is chosen in each segment: conv_id, idx, p, m."""
    of = segments.select(F.col("conv_id").alias("s_conv"), F.col("idx").alias("s_idx"), "moves")
    return chosen.join(of, F.expr("conv_id <=> s_conv and idx = s_idx")).select(
        "conv_id", "idx", "p", F.expr("filter(moves, x -> x.p = p and x.q = q)[0]").alias("m"))


def _long_answers(chunks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(conv_id, cost, audit) of conversations of several chunks, (conv_id, idx, p, audit) of their chunks, staged tables."""
    levels = [staged(chunks.where("not whole").select("conv_id", "idx", "moves"), "segments")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        levels.append(staged(_merged(levels[-1], fan), "segments"))
    tails = ", ".join(f"struct({c}L as cost, '{a}' as audit)" for c, a in ENDS.values())
    ends = levels[-1].select("conv_id", F.expr(
        f"array_min(transform(filter(moves, x -> x.p = 0), x -> struct(x.cost + array({tails})[x.q].cost as cost, "
        f"concat(x.audit, array({tails})[x.q].audit) as audit, x.q as q, array({tails})[x.q].audit as tail)))").alias("e"))
    roots = staged(ends.select("conv_id", "e.*"), "roots")
    chosen = roots.select("conv_id", F.lit(0).cast("long").alias("idx"), F.lit(0).alias("p"), "q")
    for segments in levels[:0:-1]:
        parts = _chosen_moves(chosen, segments).withColumn("k", F.explode(F.expr("sequence(0, length(m.trail) - 1)")))
        chosen = parts.select(
            "conv_id", (F.col("idx") * fan + F.col("k")).alias("idx"),
            F.expr("if(k = 0, p, cast(substring(m.trail, k, 1) as int))").alias("p"),
            F.expr("cast(substring(m.trail, k + 1, 1) as int)").alias("q"))
    last = levels[0].groupBy("conv_id").agg(F.max("idx").alias("last")).withColumnRenamed("conv_id", "l_conv")
    tail = roots.where("tail <> ''").join(last, F.expr("conv_id <=> l_conv")).select(
        "conv_id", (F.col("last") + 1).alias("idx"), F.col("q").alias("p"), F.col("tail").alias("audit"))
    audits = _chosen_moves(chosen, levels[0]).select("conv_id", "idx", "p", F.col("m.audit").alias("audit")).union(tail)
    return roots.select("conv_id", "cost", "audit"), audits, [*levels, roots]


def _applied(audits: DataFrame) -> DataFrame:
    """conv_id, idx, place, row (in its chunk), edit, role of the messages that audits (conv_id, idx, p, facts, audit) leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("row", pa.int64()), ("edit", pa.string()), ("role", pa.string())]))
        for batch in batches:
            left = [[dict(zip(("row", "edit", "role"), x, strict=True)) for x in apply(facts or "", p, audit)]
                    for facts, p, audit in zip(*(batch.column(c).to_pylist() for c in ("facts", "p", "audit")), strict=True)]
            yield _record(batch, {"messages": pa.array(left, kind)}, ("conv_id", "idx"))

    kind = dict(audits.dtypes)["conv_id"]
    return audits.mapInArrow(run, f"conv_id {kind}, idx long, messages array<struct<row:bigint,edit:string,role:string>>").select(
        "conv_id", "idx", F.posexplode("messages").alias("place", "m")).select("conv_id", "idx", "place", "m.row", "m.edit", "m.role")


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text`, newline-joined: one pass over each conversation's sorted messages."""
    kind = dict(messages.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, sha):
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], schema)

        schema, now, sha = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), pa.field("repaired_sha256", pa.string())])
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        yield row(now, sha)
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield row(now, sha)

    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "idx", "place").select(
        "conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


@dataclass
class Repair:
    messages: DataFrame       # conv_id, idx, place (their order), role, text, edit (K, R or I)
    conversations: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    chunk: int = CHUNK, fan: int = FAN,
) -> Repair:
    """Cheapest repair of each conversation with rows; both tables are staged."""
    ship(turns.sparkSession)
    wanted = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    rows = placed(wanted)
    facts = staged(with_facts(rows).select("conv_id", "turn", "nr", "initial", "fault"), "facts")
    chunks = facts.groupBy("conv_id", F.expr(f"nr div {chunk}").alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("nr", F.concat("initial", "fault").alias("x")))).alias("a")).select(
        "conv_id", "idx", F.expr("array_join(transform(a, y -> y.x), '')").alias("facts"))
    chunks = staged(_searched(chunks, chunk), "chunks")

    whole = chunks.where("whole").select("conv_id", "idx", "facts", F.col("moves")[0].alias("m"))
    answers = whole.select("conv_id", "m.cost", "m.audit")
    audits = whole.select("conv_id", "idx", F.lit(0).alias("p"), "facts", "m.audit")
    long_answers, long_audits, tables = _long_answers(chunks, fan)
    of = chunks.select(F.col("conv_id").alias("c_conv"), F.col("idx").alias("c_idx"), "facts")
    long_audits = long_audits.join(of, F.expr("conv_id <=> c_conv and idx = c_idx"), "left").select(
        "conv_id", "idx", "p", "facts", "audit")
    left = _applied(audits.union(long_audits)).withColumn("nr", F.col("idx") * chunk + F.col("row"))
    texts = rows.select(F.col("conv_id").alias("r_conv"), F.col("nr").alias("r_nr"), F.col("role").alias("own"), "text")
    messages = staged(left.join(texts, F.expr("conv_id <=> r_conv and nr = r_nr"), "left").select(
        "conv_id", "idx", "place", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit"),
        "messages")

    # Neighbours of unlike roles: inside chunks, and where chunks meet.
    letters = F.expr("array_join(transform(sequence(1, length(facts), 2), i -> substring(facts, i, 1)), '')")
    pieces = chunks.select("conv_id", "idx", letters.alias("roles"))
    inside = pieces.select("conv_id", F.expr(
        "cast(if(length(roles) < 2, 0, size(filter(sequence(1, length(roles) - 1), "
        "i -> substring(roles, i, 2) not in ('su', 'ua', 'au')))) as bigint)").alias("illegal"))
    after = pieces.where("idx > 0").select(F.col("conv_id").alias("n_conv"), (F.col("idx") - 1).alias("n_idx"), F.col("roles").alias("n_roles"))
    across = pieces.join(after, F.expr("conv_id <=> n_conv and idx = n_idx")).select("conv_id", F.expr(
        "cast(concat(right(roles, 1), left(n_roles, 1)) not in ('su', 'ua', 'au') as bigint)").alias("illegal"))
    illegal = inside.union(across).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    wide = "cast({}(turn) as decimal(20, 0))"
    counts = facts.groupBy("conv_id").agg(
        F.expr(f"coalesce({wide.format('max')} - {wide.format('min')} + 1 - count(distinct turn), 0)").alias("gaps"),
        *[F.count_if(F.col("fault") == letter).alias(name) for letter, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])

    def same(table: DataFrame, name: str) -> DataFrame:
        return table.withColumnRenamed("conv_id", name)

    conversations = staged(
        counts.join(same(illegal, "i_conv"), F.expr("conv_id <=> i_conv"))
        .join(same(answers.union(long_answers), "a_conv"), F.expr("conv_id <=> a_conv"))
        .select("conv_id", F.expr("try_cast(gaps as bigint)").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
        "conversations")
    discard(rows, facts, chunks, *tables)
    return Repair(messages, conversations)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, each row damaged by its crc32(`conv_id:turn`) modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    kinds = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    changed = kinds.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.expr("if(kind = 3, array(1, 2), array(1))").alias("copies"))
    return changed.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def repaired(turns: DataFrame) -> DataFrame:
    """Every conversation of `turns` after damage: its faults, the cheapest audit and the digest of its repair."""
    found = repair(damaged(turns))
    ids = turns.select("conv_id").distinct()
    sha = digests(found.messages).withColumnRenamed("conv_id", "d_conv")
    of = found.conversations.withColumnRenamed("conv_id", "f_conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    # Zeros are for conversations without rows; gaps beyond 64 bits stay null.
    return ids.join(of, F.expr("conv_id <=> f_conv"), "left").join(sha, F.expr("conv_id <=> d_conv"), "left").select(
        "conv_id", *[F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
