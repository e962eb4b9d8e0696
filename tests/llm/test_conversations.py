"""Conversation repair against a plain dynamic program."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from maskwright.llm.conversations import damaged, digests, repair, repaired

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, nr long, audit string"


def table(seed=1, convs=60, longest=9):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "アシ"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why?", "done.\n", "a.b", "é?"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(0, longest)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts), 5, "x"))
    rows += [(7000, i, "user", "never ends", 1, "y") for i in range(12)]  # a conversation of one kind of row
    rng.shuffle(rows)
    return rows


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def reference(rows):
    """By conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            faults.append("b" if not text.strip(SPACE) else "d" if (role, text) in seen else "t" if text.strip(SPACE)[-1] not in ".!?" else "k")
            seen.add((role, text))
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        best = {"": (0, "", ())}

        def insert(best, after=after):
            for _ in range(4):
                for state, (cost, audit, left) in list(best.items()):
                    for role in ("user", "assistant"):
                        if (state, role[0]) in after:
                            label = (cost + 2, audit + "I", (*left, f"{role}:"))
                            best[role[0]] = min(best.get(role[0], label), label)
            return best

        for (_, _, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for state, (cost, audit, left) in insert(best).items():
                ways = [(state, (cost + 3, audit + "D", left))]
                if fault in "tk":
                    late = fault == "t"
                    if (state, role[:1]) in after:
                        ways.append((role[0], (cost + late, audit + "K", (*left, f"{role}:{text}"))))
                    ways += [(r[0], (cost + 2 + late, audit + "R", (*left, f"{r}:{text}"))) for r in ("user", "assistant") if (state, r[0]) in after]
                for to, label in ways:
                    new[to] = min(new.get(to, label), label)
            best = new
        best = insert(best)
        cost, audit, left = min(best[s] for s in ("", "a") if s in best)
        turns = [r[1] for r in own if r[1] is not None]
        letters = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_repair_of_damaged_conversations(spark):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(repr, map(tuple, damaged(frame).collect()))) == sorted(map(repr, damage(rows)))
    want = reference(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want |= {r[0]: nothing for r in rows if r[0] not in want}
    got = [tuple(r) for r in repaired(frame).collect()]
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want
    assert repaired(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("chunk", "fan"), [(3, 2), (1, 3), (7, 4)])
def test_long_conversations_are_searched_in_chunks(spark, chunk, fan):
    rows = [(*r[:2], r[2] or "user", r[3] or "", *r[4:]) for r in table(seed=chunk, convs=12, longest=60)]
    found = repair(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk=chunk, fan=fan)
    sha = {r.conv_id: r.repaired_sha256 for r in digests(found.messages).collect()}
    got = {r[0]: (*r[1:], sha.get(r[0], hashlib.sha256().hexdigest())) for r in map(tuple, found.conversations.collect())}
    assert got == reference([r[:4] for r in rows])
