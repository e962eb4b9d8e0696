"""Detectors over batches of ASCII texts: the spans of the SQL fragments, for every detector and after resolution."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions import batches, fixed
from maskwright.functions.detectors import DETECTORS
from maskwright.functions.spans import SPANS, empty
from maskwright.operators.detect import detect_all, detect_raw, raw_spans, resolved_spans, searched

LISTED = [
    *fixed.PLACES, *fixed.BRANDS, *fixed.MODELS, *fixed.STREET_SUFFIXES, *fixed.NOT_STREETS, *fixed.DOB_CUES, *fixed.ID_CUES, *fixed.NOT_NAMES,
]
WORDS = [
    "VAN", "DE", "De", "El", "EL", "Ten", "Jan", "Piet", "JANSSENS", "Loo", "de", "du", "la", "von", "zu", "der", "O'Hara", "McBeth", "MacDo",
    "Jean-Pierre", "Marie", "Louis", "Mr.", "Mrs", "Dr", "Prof.", "te", "in", "naar", "uit", "bij", "richting", "vanuit", "via", "thv", "t.h.v.",
    "ter hoogte van", "Street", "Road", "Avenue", "Blvd", "Kerkstraat", "Hoofd-weg", "kerk-straat-laan", "Oak", "Hill", "rue", "des", "Lyon",
    "Hauptstrasse", "Nationaliteit", "PERSON_001", "PERSON_1062", "PERSON", "geboren", "Jangeboren", "-", "/", ".", ",", "(", ")", "+", "'", "@",
    "_", "XX", "xx", "***", "N12", "e40", "a3", "x's-gravenhage", "'s-Gravenhage", "a.b@c.de", "a@b.co_x@d.be", "x@y.zz-q@r.st", "@", "%@a.bc",
    "BE44 3770 8065 6345", "BE44377080656345", "NL20 INGB 0001 2345 67", "DE89 3704 0044 0532 0130 00", "FR76", "BE44 XXXX 8065 6345", "GB29NWBK",
    "0489/66.70.88", "0489 66 70 88", "+32 489667088", "+32 3 217 84 30", "(555) 123-4567", "555-123-4567", "+44 20 7946 0958", "0031612345678",
    "12/03/1998", "1-2-98", "12-3-1998", "1.2.2003", "123456782", "12345678 2", "60.08.26-052.12", "123-45-6789", "AB 12 34 56 C", "AB123456",
    "1 80 12 75 123 456 78", "12 345678 A 123 4", "C12345678", "12345678-Z", "X-1234567-L", "RSSMRA80A01H501U", "1234", "12345", "12345-6789",
    "1234 AB", "9000 Gent", "75001 Paris", "SW1A 1AA", "Aalst, NY 12345", "1", "07", "99", "5 rue de la Paix Vers Elle", "\x01", "\x1c", "\x1f",
]
GAPS = [" ", " ", " ", " ", "", "  ", "\n", "\t", "\r\n", "\x0b", " - ", "-", ", ", ". ", "\n\n", "/", "."]


def texts(n, seed=5):
    rng = random.Random(seed)
    made = ["", " ", "\0", "a\0b 0489 66 70 88\0Gent te Gent", "Gent", "12/03/1998", "geboren 12/03/1998", "\0" * 3 + "Jan JANSSENS - 1-2-98"]
    while len(made) < n:
        words = [rng.choice(LISTED if rng.random() < 0.25 else WORDS) for _ in range(rng.choice([1, 3, 8, 20, 40]))]
        change = rng.choice([lambda w: w] * 5 + [str.upper, str.lower, str.title])
        made.append("".join(change(w) + rng.choice(GAPS) for w in words))
    rng.shuffle(made)
    return [t for t in made if t.isascii()]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(texts(1500))]
    return dict(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(8).localCheckpoint()


def _tuples(found):
    return [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in found]


def _by_batches(all_texts, names, resolved):
    return [_tuples(f) for f in batches.spans_of(pa.array(all_texts), names, resolved).to_pylist()]


@pytest.mark.parametrize("name", list(batches.FINDERS))
def test_the_spans_of_each_detector(odd, name):
    rows, df = odd
    want = {r.doc_id: _tuples(r.s) for r in df.select("doc_id", F.expr(DETECTORS[name]("text")).alias("s")).collect()}
    got = dict(zip(rows, _by_batches(list(rows.values()), (name,), False), strict=True))
    assert sum(map(len, want.values())) > 20
    for i, text in rows.items():
        assert got[i] == want[i], (name, text)


@pytest.mark.parametrize("profile", ["patterns", "hybrid"])
def test_all_spans_and_the_disjoint_ones(odd, profile):
    rows, df = odd
    names = tuple({"patterns": fixed.PATTERN_PROFILE, "hybrid": fixed.HYBRID_PROFILE}[profile])
    for resolved, fragment in [(False, raw_spans("text", profile)), (True, resolved_spans("text", profile))]:
        want = {r.doc_id: _tuples(r.s) for r in df.select("doc_id", F.expr(fragment).alias("s")).collect()}
        got = dict(zip(rows, _by_batches(list(rows.values()), names, resolved), strict=True))
        for i, text in rows.items():
            assert got[i] == want[i], (resolved, text)


def test_texts_together_give_what_they_give_alone(monkeypatch):
    some = texts(200, seed=8)
    names = tuple(fixed.PATTERN_PROFILE)
    together = _by_batches(some, names, True)
    assert together == [_by_batches([t], names, True)[0] for t in some]
    monkeypatch.setattr(batches, "CHARS", 50)
    assert _by_batches(some, names, True) == together


def test_patterns_are_searched_wherever_they_can_begin():
    """Over all texts, candidates and stretches find what a scan of the whole string finds."""
    made = texts(3000, seed=3)
    batch = batches.Batch([t for t in made if batches.SEPARATOR not in t])
    chosen = [*batches._NAMES, *batches._MARKERS, *batches._ADDRESSES, *((p, w) for p, _, w in batches._NATIONAL_IDS if w),
              (batches._ROAD, lambda b: b.begins), (batches._DATE, batches._DATE_START), (batches._CAPS_NAME, batches._CAPS_START)]
    for pattern, where in chosen:
        assert batch.spans(pattern, where(batch)) == [m.span() for m in pattern.finditer(batch.text)], pattern.pattern
    for pattern in fixed.PHONES:
        whole = [m.span() for m in re.finditer(pattern, batch.text, re.ASCII)]
        signed, searched_as = batches._PHONES[fixed.PHONES.index(pattern)]
        at = batch.numbers.find(searched_as)
        assert [(s - (signed and batch.text[s - 1] == "+"), e) for s, e in at.tolist()] == whole, pattern


def test_islands_by_confidence_length_and_order():
    rng = random.Random(2)
    start, end, confidence, base = [], [], [], 0
    want = []
    for _ in range(60):
        rows = []
        for _ in range(rng.choice([0, 1, 2, 9, 60])):
            s = base + rng.randint(0, 90)
            rows.append((s, s + rng.randint(1, 12), rng.choice([0.8, 0.9]), len(start) + len(rows)))
        kept = []
        for x in sorted(rows, key=lambda r: (-r[2], r[0] - r[1], r[3])):
            if not any(x[0] < y[1] and x[1] > y[0] for y in kept):
                kept.append(x)
        want += [x[3] for x in sorted(kept)]
        start += [r[0] for r in rows]
        end += [r[1] for r in rows]
        confidence += [r[2] for r in rows]
        base += 110
    assert batches.resolve(np.array(start), np.array(end), np.array(confidence)).tolist() == want


def test_ascii_texts_are_searched_by_batches_and_others_by_the_fragment(spark):
    docs = spark.createDataFrame([(1, "mail a@b.be"), (2, "é a@b.be"), (3, None), (4, "")], "doc_id long, text string")
    rows = docs.select("doc_id", searched(spark, "text", ["email"], False, empty(SPANS)).alias("s")).collect()
    assert {r.doc_id: len(r.s) for r in rows} == {1: 1, 2: 0, 3: 0, 4: 0}
    both = spark.createDataFrame([(1, "mail a@b.be te Gent"), (2, "é a@b.be te Gent"), (3, None)], "doc_id long, text string")
    for found, n in [(detect_all(both), 2), (detect_raw(both), 3), (detect_raw(both, categories=["EMAIL"]), 1)]:
        assert {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()} == {1: n, 2: n}
    assert "ArrowEvalPython" in detect_all(both)._jdf.queryExecution().executedPlan().toString()
