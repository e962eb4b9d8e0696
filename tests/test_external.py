"""Entities of models, and files."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import external as ext
from maskwright.operators.joins import without_overlaps
from maskwright.sources import files

SCHEMA = "doc_id bigint, start int, end int, text string, label string, score double, lang string, ord int"


def test_language_codes(spark):
    df = spark.createDataFrame([(" Vlaams ",), ("EN",), ("français",)], "l string")
    assert [r.c for r in df.select(F.expr(ext.language_code("l")).alias("c")).collect()] == ["nl", "en", "fr"]
    with pytest.raises(Exception, match="unknown language"):
        spark.createDataFrame([("klingon",)], "l string").select(F.expr(ext.language_code("l")).alias("c")).collect()


def test_interval_anti_join_over_block_edges(spark):
    spans = spark.createDataFrame([(1, 5, 25), (1, 30, 31), (2, 5, 25)], "doc_id bigint, start int, end int")
    others = spark.createDataFrame([(1, 24, 30), (2, 25, 26)], "doc_id bigint, start int, end int")
    kept = without_overlaps(spans, others, size=10)
    assert sorted(map(tuple, kept.collect())) == [(1, 30, 31), (2, 5, 25)]


def test_hybrid_keeps_the_earlier_entity(spark):
    patterns = spark.createDataFrame([(1, 0, 4, "abcd", "PHONE", 0.95, 0)],
                                     "doc_id bigint, start int, end int, text string, category string, confidence double, ord int")
    entities = spark.createDataFrame([
        (1, 3, 8, "xxxxx", "PER", 1.0, "nl", 0), (1, 10, 14, "Anna", "PER", 1.0, "nl", 1), (1, 12, 30, "na" * 9, "LOC", 1.0, "nl", 2),
        (1, 40, 44, "Gent", "ORG", 1.0, "nl", 3), (1, 50, 55, "email", "PER", 1.0, "nl", 4)], SCHEMA)
    kept = sorted((r.start, r.category) for r in ext.hybrid_spans(patterns, entities).collect())
    assert kept == [(0, "PHONE"), (10, "PERSON")]
    assert ext.hybrid_spans(patterns, entities, include_org=True).count() == 3


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("één regel\ntwee", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("één".encode("latin-1"))
    utf = files.read_texts(spark, f"{tmp_path}/a.txt").first()
    assert utf.text == "één regel\ntwee"
    assert files.read_texts(spark, f"{tmp_path}/b.txt", "iso-8859-1").first().text == "één"
    names = files.output_names(files.read_texts(spark, f"{tmp_path}/a.txt")).first()
    assert (names.sanitized_name, names.mapping_name, names.decoded_name) == ("a_sanitized.txt", "a_mapping.json", "a_decoded.txt")
    assert files.inventory(spark, str(tmp_path)).count() == 2
