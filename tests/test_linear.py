"""Work inside one row: the same as plain Python, and not slower by the square of the matches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright import decode, encode
from maskwright.functions.resolve import resolve
from maskwright.functions.spans import SPANS, let, walk, without_overlaps, without_places
from maskwright.operators.rewrite import encode_each, entries_table

def spans(rng, n, width, reach):
    out = []
    for i in range(n):
        start = rng.randint(0, reach)
        out.append((start, start + rng.randint(1, width), f"t{rng.randint(0, 9)}", "C", rng.choice([0.8, 0.85, 0.9]), "d", 0, 0, i))
    return out


def overlaps(a, b):
    return a[0] < b[1] and a[1] > b[0]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(11)
    rows = [(i, spans(rng, rng.choice([0, 1, 5, 70, 300]), rng.choice([3, 20]), 900), spans(rng, rng.choice([0, 1, 9, 130]), 15, 900)) for i in range(40)]
    return rows, spark.createDataFrame(rows, f"id int, a {SPANS}, b {SPANS}").repartition(4)


def found(df, expression):
    return {r.id: r.x if r.x is None else [tuple(s) if isinstance(s, tuple) else s for s in r.x] for r in df.select("id", F.expr(expression).alias("x")).collect()}


def test_walk(pairs):
    rows, df = pairs
    got = found(df, let("v", "transform(a, s -> s.start)", walk("v", "0", "acc.a + r", "acc.a * 1000 + acc.n", "int")))
    for i, a, _ in rows:
        total, want = 0, []
        for n, s in enumerate(a):
            want.append(total * 1000 + n)
            total += s[0]
        assert got[i] == want


def test_spans_without_others(pairs):
    rows, df = pairs
    one_each = "filter(a, (s, i) -> not exists(slice(a, 1, i), o -> o.start = s.start and o.end = s.end))"
    free, places = found(df, without_overlaps("a", "b")), found(df, let("p", one_each, without_places("p", "b")))
    for i, a, b in rows:
        assert free[i] == [x for x in a if not any(overlaps(x, y) for y in b)]
        want = [x for k, x in enumerate(a) if x[:2] not in {y[:2] for y in [*b, *a[:k]]}]
        assert sorted(places[i]) == sorted(want)


def test_resolution(pairs):
    rows, df = pairs
    got = found(df, resolve("a"))
    for i, a, _ in rows:
        kept = []
        for x in sorted(a, key=lambda s: (-s[4], s[0] - s[1], s[8])):
            if not any(overlaps(x, y) for y in kept):
                kept.append(x)
        assert [s[:2] for s in got[i]] == sorted(s[:2] for s in kept)


def mails(n):
    return ", ".join(f"p{i}@ex{i % 7}.com" for i in range(n)) + " en p0@ex0.com"


def test_many_matches_in_one_text(spark):
    def took(n):
        docs = spark.createDataFrame([(1, mails(n))], "doc_id long, text string")
        started = time.time()
        done = encode_each(docs).collect()[0]
        took = time.time() - started
        assert len(done.entries) == n and done.text.count("EMAIL_") == n + 1
        return took

    took(100)
    few, many = took(3_000), took(24_000)
    assert many < 30 * max(few, 1.0)  # eight times the matches; sixty-four times the work if it went by pairs


def test_per_document_decoding_restores_each_document(spark):
    rows = [(i, f"mail a{i}@x.be, b{i}@x.be, a{i}@x.be en PERSON_999") for i in range(20)] + [(99, mails(700)), (100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded = encode_each(docs)
    texts = encoded.select("doc_id", "text")
    back = decode(texts, entries_table(encoded), scope="document")
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert {r.text for r in texts.where("doc_id < 99").collect()} == {"mail EMAIL_001, EMAIL_002, EMAIL_001 en PERSON_999"}


def test_model_profiles_need_entities(spark):
    docs = spark.createDataFrame([(1, "Jan belt Piet")], "doc_id long, text string")
    entities = spark.createDataFrame(
        [(1, 0, 3, "Jan", "PERSON", 0.9, "nl", 0), (1, 9, 13, "Piet", "PERSON", 0.3, "nl", 1), (2, 0, 3, "Els", "PERSON", 0.9, "nl", 0)],
        "doc_id long, start int, end int, text string, label string, score double, lang string, ord int")
    with pytest.raises(ValueError, match="needs entities"):
        encode(docs, profile="zero_shot")
    done = encode(docs, profile="rule_engine", entities=entities)
    assert [r.text for r in done.text.collect()] == ["PERSON_001 belt Piet"]
    assert [r.canonical for r in done.mapping.collect()] == ["Jan"]
    assert [r.text for r in encode(docs, profile="rule_engine", entities=entities, threshold=0.2).text.collect()] == ["PERSON_002 belt PERSON_001"]
