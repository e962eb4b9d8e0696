"""Raw spans of some categories: the same rows as those of all detectors, without searching for the rest."""

from maskwright.functions.detectors import CATEGORIES, DETECTORS, custom
from maskwright.operators.detect import detect_raw, detectors_of

TEXTS = [
    "VAN LOOVEREN Arin, geboren op 02/03/1970 te Gent. Tel 0489/12.34.56 mail c1@example.com rekening BE44 3770 8065 6345; bsn 123456782.",
    "Hoofdstraat 12, 9000 Gent. Rijdt met BMW X5 op N12 richting Antwerpen. Kampweg, GOOSSENS Jan - 01-02-1980.", "", "niets",
]
COLUMNS = ["doc_id", "start", "end", "text", "category", "confidence", "detector"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_categories_of_detectors(docs):
    for name, category in CATEGORIES.items():
        assert {r.category for r in detect_raw(docs(*TEXTS), [name]).collect()} <= {category}
    assert CATEGORIES.keys() == DETECTORS.keys()


def test_some_categories_are_those_rows_of_all(docs):
    every = _rows(detect_raw(docs(*TEXTS)))
    for wanted in (["PHONE"], ["PERSON", "PLACE"], ["NONE"]):
        assert _rows(detect_raw(docs(*TEXTS), categories=wanted)) == [r for r in every if r[4] in wanted]
    own = custom("dossier", "CASE", "niets", 0.9)
    assert [r[3] for r in _rows(detect_raw(docs(*TEXTS), ["phone", own], categories=["CASE"]))] == ["niets"]


def test_other_detectors_do_not_search():
    assert detectors_of("patterns", ["PHONE"]) == [DETECTORS["phone"]]
    assert len(detectors_of("patterns")) == 13
