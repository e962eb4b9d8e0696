"""Offsets by marks: texts with and without the mark, ASCII and not, against Python's regexes."""

import re

from pyspark.sql import functions as F

from maskwright.functions.detectors import DETECTORS
from maskwright.functions.spans import MARK, find, find_terms, matches, u

TEXTS = [
    "", "no digits", "12", "a 12 b34c 5", f"a{MARK}12 b{MARK}34{MARK}", MARK, f"{MARK}7", "é 12 ü34 😀5 x", f"é{MARK} 12 😀 3",
    "gent Gent, gentse antwerpen-gent", f"Gent{MARK}gent", "é Gent", "9 " * 200 + "x",
]


def _rows(docs, fragment):
    found = docs(*TEXTS).select("text", F.expr(fragment).alias("found")).collect()
    return {r.text: [(x.start, x.end, x.text, x.grp) for x in r.found] for r in found}


def test_offsets_with_and_without_marks(docs):
    got = _rows(docs, find("text", u(r"\d(\d?)"), group=1))
    for text in TEXTS:
        assert got[text] == [(m.start(), m.end(), m[0], m[1]) for m in re.finditer(r"\d(\d?)", text)], text
    got = _rows(docs, find("text", u(r"[a-z]+")))
    for text in TEXTS:
        assert got[text] == [(m.start(), m.end(), m[0], None) for m in re.finditer(r"[a-z]+", text)], text


def test_terms_with_and_without_marks(docs):
    got = _rows(docs, find_terms("text", ["gent", "antwerpen", "antwerpen-gent"]))
    for text in TEXTS:
        pattern = r"\b(?=(antwerpen-gent|antwerpen|gent)\b)"
        want = [(m.start(), m.end(1), m[1], None) for m in re.finditer(pattern, text, re.IGNORECASE)]
        assert got[text] == want, text


def test_a_literal_pattern_is_scanned_once_and_never_compiled_by_row():
    fragment = find("text", u(r"\d+")).partition(" else ")[2]
    assert "regexp_extract_all" not in fragment and fragment.count("regexp_replace") == 2  # one a script


def test_ascii_texts_are_searched_without_the_unicode_flag():
    assert "'\\\\d+'" in matches("text", u(r"\d+"))
    assert "octet_length" not in matches("text", u(r"\p{Punct}"))  # means other ASCII characters


def test_null_texts_have_no_spans(spark):
    empty = spark.createDataFrame([(None,), ("",)], "text string")
    for name, detector in DETECTORS.items():
        assert not any(r.s for r in empty.select(F.expr(detector("text")).alias("s")).collect()), name
