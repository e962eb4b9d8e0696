"""Spans against the same patterns in Python's own regex engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.detectors import _CAPS_NAME, _any_street
from maskwright.functions.spans import find, find_terms, lit, u
from maskwright.operators.detect import detect

FRAGMENTS = [
    "0489/66.70.88", "+32 3 217 84 30", "32489667088", "(555) 123-4567", "020 7946 0958", "a@b.com-x@y.org", "jan@just.fgov.be",
    "BE44 3770 8065 6345", "NL91ABNA0417164300", "BE44 XXXX 8065 6345", "09/06/1998", "geboren op", "né le", "12345", "SW1A 1AA",
    "9000 Gent", "12 rue de la Paix", "75001 Paris-Nord", "Hauptstraße 12", "Kampweg", "niet-uitvoering", "Sint-Jacobsstraat",
    "Kampweg-noord", "5straatweg", "DE GROOT", "Van Looveren Thomas", "Jean-Pierre Dupont", "O'Brien", "McDonald", "VAN EERSTE", "VAN  EERSTE",
    "Mr. John Smith", "von der Leyen", "te Wuustwezel", "richting breda", "t.h.v. Aalst", "WUUSTWEZEL 2990", "Köln", "KÖLN", "xKöln",
    "Sint-Jans-Molenbeek", "'s-Gravenhage", "Den Haag", "fiat seat ibiza", "Mercedes-Benz Sprinter", "renault trucks", "a3", "vw golf",
    "N133", "e40", "bsn", "123456782", "93.04.26-123.45", "AB12 34 56 C", "OPO KUAA Daniel Kwame", "- 27-01-2001", "–", "-", "27-01-2001",
    "Dikila-Djokoto D'Arcki", "THOMPSON", "Nationaliteit", "PERSON_1062", "Salu Kia Zola", "geboren", "Abgeboren", "de", "I", "x", "é", "ß",
    "😀", "_", "9", ",", ".", "\n", "  ", " ", "Jan", "Karel", "ABC", "van", "der", "--",
]


def samples(n=1500, seed=7):
    rng = random.Random(seed)
    glue = ["", " ", " ", " ", "\n", ", ", "-"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(FRAGMENTS) + rng.choice(glue) for _ in range(rng.randint(1, 14))))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = samples()
    return rows, spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(8).cache()


def spark_found(df, expression):
    out = {}
    for row in df.select("doc_id", F.expr(expression).alias("f")).collect():
        out[row.doc_id] = row.f
    return out


ALL = (fixed.PHONES + [fixed.EMAIL] + fixed.IBANS + [fixed.DATE] + [p for p in fixed.ADDRESSES if "é-]+)*" not in p]
       + [p for p, _ in fixed.NATIONAL_IDS] + [fixed.PREPOSITION_PLACE] + fixed.LOCATION_MARKERS + fixed.PRECISE_STREETS
       + fixed.NAMES + [fixed.ROAD])


def test_offsets_equal_finditer(texts):
    rows, df = texts
    got = spark_found(df, find("text", *[u(p) for p in ALL]))
    for i, text in enumerate(rows):
        want = [(m.start(), m.end(), m.group(), nr) for nr, p in enumerate(ALL) for m in re.finditer(p, text)]
        assert [(f.start, f.end, f.text, f.nr) for f in got[i]] == want, text


def rewritten(df, rows, detector, patterns, keep=lambda m: True, group=0, strip=False, flags=0):
    """Positions a detector reports (all its rows) equal those of the plain patterns."""
    got = {}
    for r in detect(df, detector).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end, r.text))
    for i, text in enumerate(rows):
        want = set()
        for p in patterns:
            for m in re.finditer(p, text, flags):
                if keep(m):
                    want.add((m.start(group), m.end(group), m.group(group)))
        assert got.get(i, set()) == want, text


def test_email_without_backtracking(texts):
    rows, df = texts
    rewritten(df, rows, "email", [fixed.EMAIL])


def test_addresses_with_bounded_recursion(texts):
    rows, df = texts
    rewritten(df, rows, "address", fixed.ADDRESSES, keep=lambda m: "\n" not in m.group())


def test_any_street_without_backtracking(texts):
    rows, df = texts
    got = spark_found(df, find("text", u(_any_street(), ignore_case=True)))
    for i, text in enumerate(rows):
        want = [(m.start(), m.end()) for m in re.finditer(fixed.ANY_STREET, text, re.IGNORECASE)]
        assert [(f.start, f.end) for f in got[i]] == want, text


def test_terms_equal_one_scan_per_term(texts):
    rows, df = texts
    got = spark_found(df, find_terms("text", fixed.PLACES))
    for i, text in enumerate(rows):
        want = sorted((m.start(), m.end()) for t in fixed.PLACES for m in re.finditer(r"\b" + re.escape(t) + r"\b", text, re.IGNORECASE))
        assert [(f.start, f.end) for f in got[i]] == want, text


def test_vehicles_equal_one_scan_per_term(texts):
    rows, df = texts
    got = {}
    for r in detect(df, "vehicle").collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end))
    for i, text in enumerate(rows):
        brands = {(m.start(), m.end()) for b in fixed.BRANDS
                  for m in re.finditer(rf"\b{re.escape(b)}{fixed.BRAND_TAIL}\b", text, re.IGNORECASE) if len(m.group()) >= 3}
        models = {(m.start(), m.end()) for t in fixed.MODELS for m in re.finditer(rf"\b{re.escape(t)}\b", text, re.IGNORECASE)}
        free = {m for m in models if not any(m[0] < e and m[1] > s for s, e in brands)}
        assert got.get(i, set()) == brands | free, text


def test_context_names_equal_plain_patterns(texts):
    rows, df = texts
    got = {}
    for r in detect(df, "context_name").collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end, r.text, round(r.confidence, 2)))
    for i, text in enumerate(rows):
        dated = {(m.start(1), m.end(1)) for m in re.finditer(fixed.NAME_BEFORE_DATE, text)
                 if len(m.group(1)) >= 3 and m.group(1).lower() not in fixed.NOT_NAMES_BEFORE_DATE}
        caps = {(m.start(1), m.start(1) + len(m.group(1).strip())) for m in re.finditer(fixed.CAPS_NAME, text)
                if m.group(1).strip() not in fixed.NOT_CAPS_NAMES}
        caps = {c for c in caps if not any(c[0] < e and c[1] > s for s, e in dated)}
        tokens = {(m.start(1), m.end(1)) for m in re.finditer(fixed.NAME_BEFORE_TOKEN, text)} - dated - caps
        want = ({(s, e, text[s:e], 0.88) for s, e in dated} | {(s, e, text[s:e], 0.85) for s, e in caps}
                | {(s, e, text[s:e], 0.82) for s, e in tokens})
        assert got.get(i, set()) == want, text


def test_long_runs_of_words_do_not_overflow(spark, docs):
    long = docs(
        "12 rue de la " + "Paix " * 5000, "ABC " + "Paix " * 8000, "Paix " * 8000 + "PERSON_001", "Jan " * 6000 + "- 01-02-2003",
        "12345 Paix" + "-Paix" * 8000, "ABC" + " Paix" * 6000 + " geboren",
    )
    for name in ["address", "context_name", "name"]:
        assert detect(long, name).count() > 0
    row = detect(long, "context_name").where("doc_id = 4").first()
    assert (row.start, row.end) == (0, 6000 * 4 - 1)


def test_runs_equal_the_plain_patterns_at_any_length(spark):
    rng = random.Random(1)
    caps = ["ABC ", "ABC", " Abgeboren", " Paix", " Nationaliteit", " Nationaliteitgeboren", "geboren", " geboren", " - 01-",
            " PERSON_", "\n", "x", " Ab", " P", " Ageborengeboren", " Xgeboren", ".", "DEFG"]
    texts = ["".join(rng.choices(caps, k=rng.randint(1, 14))) for _ in range(400)]
    texts += ["ABC " + "Abgeboren Paix " * n + " einde" for n in (30, 60, 5000)] + ["ABC" + " Nationaliteit Jan" * 5000]
    heads = ["12 rue ", "12345 ", "9 avenue de la "]
    tails = ["Paix", " Paix", " P--", " P-", " P", " Pa-", " Pa-ix", "-Paix", "--P", "X", " X", "é", " Dé--", ".", "\n", " ", "-", "1"]
    texts += [rng.choice(heads) + "".join(rng.choices(tails, k=rng.randint(1, 14))) for _ in range(600)]
    texts += ["12 rue Paix" + " P--" * n for n in (3, 60, 5000)] + ["12 rue Paix" + " Pa-" * 60 + " P--" * 60]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {}
    for r in detect(frame, "address").collect():
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
    for i, text in enumerate(texts):
        plain = {(m.start(), m.end()) for p in fixed.ADDRESSES for m in re.finditer(p, text) if "\n" not in m.group()}
        assert spans.get(i, set()) == plain, text[:80]
    found = dict(frame.selectExpr("doc_id", f"regexp_extract_all(text, {lit(_CAPS_NAME)}, 1)").collect())
    for i, text in enumerate(texts):
        assert found[i] == re.findall(fixed.CAPS_NAME, text), text[:80]


def test_emails_stay_linear(docs):
    assert detect(docs("a." * 20000 + "@", "x" * 50000 + " @"), "email").count() == 0
