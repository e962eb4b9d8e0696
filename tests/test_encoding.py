"""End to end: encode, decode, mapping, strategies, reports."""

import json

import pytest
from pyspark.sql import functions as F

from maskwright import (
    Strategy, analyse, build_mapping, custom, decode, detect, detect_all, encode, extend_mapping, find_placeholders,
    get_strategy, legend, sanitise, statistics, validate, with_legend,
)
from maskwright.functions.text import normalise, placeholder
from maskwright.operators import mapping as maps
from maskwright.operators.joins import lookup
from maskwright.operators.pages import chunk, split_parts
from maskwright.operators.resolve import resolve_spans
from maskwright.operators.rewrite import kept_spans, prepare

COURT = """
Arrondissement Limburg, dossier in onderzoek
Opgesteld door
Mia PEETERS
3500 Hasselt
Tel: 011/34.52.18
mia.peeters@kantoor.example.be

CLAESSEN Ruben Tom, geboren op 14/02/1987 te Maaseik, thans zonder adres;
Gehoord over de levering van 40 kratten die op 03/05/2021 werd gezien.
Het nummer 32477120945 belde met DE WOLF Hanne.
DE WOLF Bart, 3600 Genk - Molenstraat 12/B000 - broer van DE
WOLF Hanne en Noor
Rekening: BE71 0961 2345 6769
Bericht aan stad.loket@genk.example.be of +32 3 456 71 02.
"""


def text_of(df, doc_id=1):
    return {r.doc_id: r.text for r in df.collect()}[doc_id]


@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_court_text(docs, scope):
    df = docs(COURT)
    done = encode(df, scope=scope)
    clean = text_of(done.text)
    for stays in ["broer van", "geboren op", "Gehoord over", "thans zonder", "Rekening:", "40 kratten", "03/05/2021"]:
        assert stays in clean
    for goes in ["CLAESSEN Ruben", "DE WOLF Hanne", "Mia PEETERS", "011/34.52.18", "32477120945", "+32 3 456 71 02",
                 "mia.peeters@kantoor.example.be", "stad.loket@genk.example.be", "BE71 0961 2345 6769", "14/02/1987"]:
        assert goes not in clean
    restored = text_of(decode(done.text, done.mapping, scope=scope))
    assert restored == COURT.replace("DE\nWOLF", "DE WOLF")
    assert text_of(decode(done.text, done.mapping, strict_tokens=True, scope=scope)) == restored


def test_same_value_same_placeholder(docs):
    done = encode(docs("DE WOLF Hanne wrote to DE WOLF Noor. DE WOLF Hanne waits, and DE WOLF Hanne leaves."))
    token = done.mapping.where("canonical = 'DE WOLF Hanne'").first().placeholder
    assert text_of(done.text).count(token) == 3


def test_numbers_count_from_the_end(docs):
    assert text_of(encode(docs("a@x.be b@x.be")).text) == "EMAIL_002 EMAIL_001"


def test_empty_and_clean_and_null(docs):
    clean = "Nothing in here tells who anybody is."
    done = encode(docs("", clean, None))
    assert [r.text for r in done.text.orderBy("doc_id").collect()] == ["", clean, None]
    assert done.mapping.count() == 0


def test_forms_of_a_phone_number(docs):
    row = encode(docs("0489/66.70.88 en 0489 66 70 88")).mapping.first()
    assert (row.occurrences, row.variations) == (2, ["0489 66 70 88", "0489/66.70.88"])


def test_category_of_first_occurrence_wins(spark):
    spans = spark.createDataFrame(
        [(1, 0, 4, "Gent", "STREET"), (1, 9, 13, "GENT", "PLACE"), (2, 0, 4, "gent", "VEHICLE")],
        "doc_id bigint, start int, end int, text string, category string")
    row = build_mapping(spans).first()
    assert (row.placeholder, row.canonical, row.occurrences) == ("PLACE_001", "GENT", 3)


def test_small_rules(docs):
    def texts(name, value):
        return [r.text for r in detect(docs(value), name).orderBy("start").collect()]

    assert texts("dob", "aangetroffen op 16/10/2023") == []
    assert texts("national_id", "123456782 en 123456789") == ["123456782"]
    assert texts("iban", "BE44 XXXX 8065 6345") == []
    assert texts("place", "Köln, KÖLN en xKöln") == ["Köln", "KÖLN"]
    assert texts("name", "VAN EERSTE") == []
    assert [r.text for r in detect_all(docs("fiat seat ibiza")).collect()] == ["seat ibiza"]


def test_masks(spark):
    rows = [("Jan de Vries", "PERSON", "*** ** V**es"), ("0612345678", "PHONE", "06******78"), ("06-12 34", "PHONE", "06-** 34"),
            ("1234", "PHONE", "****"), ("jan@example.com", "EMAIL", "j**@e******.com"), ("jan@host", "EMAIL", "j**@****"),
            ("BE44 3770 8065 6345", "IBAN", "BE44 **** **** 6345"), ("BE44377080656345", "IBAN", "BE44********6345"), ("BE4437", "IBAN", "******")]
    df = spark.createDataFrame(rows, "v string, c string, want string")
    for r in df.select("*", F.expr(get_strategy("mask").sql("v", "c")).alias("got")).collect():
        assert r.got == r.want
    keep = F.expr(get_strategy("mask", mask_char="#", keep_start=2, keep_end=0).sql("v", "'PERSON'"))
    assert df.select(keep.alias("m")).first().m == "Ja# ## Vr###"


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        get_strategy("shred")
    with pytest.raises(ValueError):
        get_strategy("encrypt", key="short")
    with pytest.raises(ValueError):
        from maskwright.operators.detect import detectors_of
        detectors_of("tarot")


def test_own_strategy_with_a_pandas_udf(docs):
    import pandas as pd

    @F.pandas_udf("string")
    def shout(values: pd.Series) -> pd.Series:
        return "<" + values.str.upper() + ">"

    own = Strategy("shout", column=lambda value, category: shout(value))
    assert text_of(encode(docs("mail a@x.be nu"), strategy=own).text) == "mail <A@X.BE> nu"


def test_own_labels(docs):
    label = custom("case", "CASE", r"\bcase \d+\b", 0.9, cues=["see"])
    assert [r.text for r in detect(docs("see case 12. " + "x" * 40 + " case 13"), label).collect()] == ["case 12"]


def test_encryption_restores(docs):
    from maskwright.functions.strategies import decrypt

    key = "0123456789abcdef0123456789abcdef"
    sealed = sanitise(docs("a@x.be"), "encrypt", key=key)
    assert sealed.select(F.expr(decrypt("text", key)).alias("t")).first().t == "a@x.be"


def test_wide_numbers(spark):
    df = spark.range(1).select(F.expr(placeholder("'PERSON'", "1000")).alias("p"))
    assert df.first().p == "PERSON_1000"
    mapping = spark.createDataFrame([(0, "PERSON_10000", "PERSON", 10000, "X", "x", ["x"], 1)], maps.SCHEMA)
    text = spark.createDataFrame([(1, "PERSON_10000 PERSON_999")], "doc_id bigint, text string")
    assert text_of(decode(text, mapping)) == "x PERSON_999"
    assert text_of(decode(text, mapping, strict_tokens=True)) == "PERSON_10000 PERSON_999"
    assert find_placeholders(text).count() == 1


def test_block_numbering_equals_one_window(spark, docs):
    spans = kept_spans(prepare(docs(*[f"mail m{i % 37}@x.be of 0489/66.70.{i % 90 + 10}" for i in range(300)]))).cache()
    one, many = [sorted(map(str, build_mapping(spans, blocks=b).collect())) for b in (1, 7)]
    assert one == many


def test_extension_equals_whole(docs):
    df = docs(*[f"mail m{i % 7}@x.be bij JANSSENS Jan{chr(97 + i % 5)}" for i in range(40)])
    whole = encode(df)
    first = encode(df.where("doc_id <= 15"))
    rest = encode(df.where("doc_id > 15"), mapping=first.mapping)
    assert sorted(map(str, rest.mapping.collect())) == sorted(map(str, whole.mapping.collect()))
    both = first.text.unionByName(rest.text)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.text.collect()))


def test_mapping_files(docs):
    mapping = encode(docs(COURT)).mapping
    files = maps.to_json(mapping, "2030-01-01")
    data = json.loads(files.first().json)
    assert data["version"] == "1.0" and data["statistics"]["EMAIL"] == 2
    assert maps.from_json(files).count() == mapping.count()
    assert sorted(r.norm for r in maps.from_json(files).collect()) == sorted(r.norm for r in mapping.collect())


def test_shared_keys_in_mapping_files(spark):
    text = '{"mappings": {"PLACE_001": {"canonical": "Gent"}, "STREET_004": {"canonical": "gent"}}}'
    rows = {r.placeholder: r for r in maps.from_json(spark.createDataFrame([(0, text)], "scope bigint, json string")).collect()}
    assert rows["PLACE_001"].norm is None and rows["STREET_004"].norm == "GENT"
    assert rows["STREET_004"].num == 4 and rows["STREET_004"].variations == ["gent"] and rows["STREET_004"].occurrences == 1


def test_hot_keys_join_like_others(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("norm"), "id")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "norm string, value int")
    plain = left.join(right, "norm", "left")
    assert sorted(map(str, lookup(left, right, ["norm"], hot_rows=100).collect())) == sorted(map(str, plain.collect()))


def test_resolution_of_tables_is_greedy(spark):
    import random

    rng, rows = random.Random(3), []
    for d in range(30):
        for i in range(rng.randint(1, 40)):
            s = rng.randint(0, 120)
            rows.append((d, s, s + rng.randint(1, 12), rng.choice([0.8, 0.9, 0.95]), i))
    df = spark.createDataFrame(rows, "doc_id bigint, start int, end int, confidence double, ord int")
    for block in (10, 100_000):
        got = {(r.doc_id, r.start, r.end) for r in resolve_spans(df, block=block).collect()}
        want = set()
        for d in range(30):
            kept = []
            for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1] - r[2], r[4])):
                if all(r[2] <= k[1] or r[1] >= k[2] for k in kept):
                    kept.append(r)
            want |= {(d, k[1], k[2]) for k in kept}
        assert got == want


def test_chunks_and_parts(docs):
    text = ("Een zin. " * 30 + "\n\n") * 3
    chunks = chunk(docs(text), 200).orderBy("chunk").collect()
    assert "".join(c.text for c in chunks) == text
    pages = "\n\n".join(f"--- Page {i} ---\npagina {i}" for i in range(1, 6))
    parts = [r.text for r in split_parts(docs(pages), 2).orderBy("part").collect()]
    assert parts == ["pagina 1\n\npagina 2", "pagina 3\n\npagina 4", "pagina 5"]
    assert split_parts(docs("x" * 50), 2, unmarked="whole", size=10).count() == 1
    assert split_parts(docs("x" * 50), 2, size=10).count() == 3


def test_reports(docs):
    df = docs(COURT, "niets")
    done = encode(df)
    total = statistics(done.mapping).where("category is null").first()
    assert total.unique_values == done.mapping.count()
    assert "  EMAIL_NNN : Email addresses (2 unique)" in legend(done.mapping).first().legend
    assert text_of(with_legend(done.text, done.mapping), 2).endswith("=\nniets")
    assert analyse(df).where("doc_id = 1 and category = 'EMAIL'").first().found == 2


def test_validation(spark):
    df = spark.createDataFrame([(1, "abc def", "x", "abc xef"), (2, "abc", "x", "abcd"), (3, "a", "x", "a")],
                               "doc_id bigint, original string, sanitised string, decoded string")
    rows = {r.doc_id: r for r in validate(df).collect()}
    assert rows[1].first_diff_position == 4 and rows[1].first_diff_decoded == "abc xef"
    assert rows[2].first_diff_position is None and not rows[2].content_match
    assert rows[3].content_match


def test_normal_forms(spark):
    rows = [("EL MANSOURI Brahim", "PERSON", "BRAHIM|MANSOURI"), ("El Mansouri Brahim", "PERSON", "BRAHIM|MANSOURI"), ("Van De", "PERSON", ""),
            ("0032 489", "PHONE", "+32489"), ("0489/66.70.88", "PHONE", "+32489667088"), ("be44 3770", "IBAN", "BE443770"), (" straße ", "PLACE", "STRASSE")]
    df = spark.createDataFrame(rows, "v string, c string, want string")
    for r in df.select("*", F.expr(normalise("v", "c")).alias("got")).collect():
        assert r.got == r.want
