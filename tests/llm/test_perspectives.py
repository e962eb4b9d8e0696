"""Perspective rotation against a plain rendering."""

from __future__ import annotations

import random

from maskwright.llm.perspectives import perspectives


def render(messages, me):
    text, masks = "", []
    for name, body in messages:
        label = "system" if name == "system" else "assistant" if name == me else f"user:{name}"
        text += f"<|{label}|>\n"
        start = len(text)
        text += body + "<|end|>"
        if name == me:
            masks.append((start, len(text)))
        text += "\n"
    return text, masks


def test_perspectives(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["ann", "bob", "céd"]), f"message {t} 🙂", "x", 1) for t in range(500)]  # one hot conversation
    rows += [(2, 0, "system", "rules", "x", 1), (2, 1, "ann", None, "x", 1), (2, 2, None, "<|end|> trick <|x", "x", 1)]
    rows += [(3, 0, "system", "nobody", "x", 1), (None, None, "ann", "a", "x", 1), (None, 1, "ann", "b", "x", 1)]
    rows += [(4, 0, "ann", "same", "x", 1)] * 3 + [(4, 0, "bob", "tie", "x", 1), (5, 0, "ann", "", "x", 1)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    frame = spark.createDataFrame(
        shuffled, "conv_id long, turn long, role string, text string, participant string, part int").repartition(3)
    got = {}
    for r in perspectives(frame, part_turns=16).orderBy("part").collect():
        assert r.n_messages <= 16 and all(r.text[a:b].endswith("<|end|>") for a, b in r.masks)
        text, masks = got.get((r.conv_id, r.participant), ("", []))
        got[r.conv_id, r.participant] = (text + r.text, masks + [(a + len(text), b + len(text)) for a, b in r.masks])
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "unknown", (r[3] or "").replace("<|", "< |")) for r in sorted(
            (r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "unknown", r[3] or ""))]
        for me in {n for n, _ in mine} - {"system"}:
            want[conv, me] = render(mine, me)
    assert got == want and (2, "unknown") in got and (3, "system") not in got
    assert perspectives(spark.createDataFrame([], frame.schema)).count() == 0
