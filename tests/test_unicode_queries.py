"""Queries on texts as they are, against plain regexes."""

import re

from maskwright.functions import fixed
from maskwright.plans.queries import QUERIES

TEXTS = [
    "Één café: mevrouw belt 0489/12.34.56 naar Gent, é0489/12.34.57 niet. Çà et là, naïef.",
    "Zoë Müller uit Köln mailt zoe@example.com, bel 0489 12 34 58 in Aalst; straße en Gentö.",
]


def test_documents_keep_their_characters(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.start, r.end, r.text) for r in QUERIES["detect_phone_documents_unicode"](spark, str(tmp_path)).collect()}
    want = {(i, m.start(), m.end(), m.group()) for i, t in enumerate(TEXTS) for p in fixed.PHONES for m in re.finditer(p, t)}
    assert want and found == want
    places = {(r.doc_id, r.start, r.end) for r in QUERIES["detect_place_documents_unicode"](spark, str(tmp_path)).collect()
              if r.confidence > 0.9}
    assert places == {(i, m.start(), m.end()) for i, t in enumerate(TEXTS) for p in fixed.PLACES
                      for m in re.finditer(rf"(?i)\b{re.escape(p)}\b", t)}
    for name in ("address", "any_street", "context_place", "name"):
        rows = QUERIES[f"detect_{name}_documents_unicode"](spark, str(tmp_path)).collect()
        assert all(TEXTS[r.doc_id][r.start:r.end] == r.text for r in rows)
    spans = QUERIES["resolve_overlaps_documents_unicode"](spark, str(tmp_path)).collect()
    assert spans and all(TEXTS[r.doc_id][r.start:r.end] == r.text for r in spans)


def test_conversion_keeps_characters(spark, tmp_path):
    spark.createDataFrame([(1, i, "user", t) for i, t in zip((1, 3), TEXTS)], "conv_id long, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    text = " ".join(r.text for r in QUERIES["convert_and_sanitise_unicode"](spark, str(tmp_path)).collect())
    assert "café" in text and "Çà et là, naïef" in text and "straße" in text
    assert "zoe@example.com" not in text and "0489 12 34 58" not in text
