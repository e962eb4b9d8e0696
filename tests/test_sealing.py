"""Encryption with keys from a table."""

import pytest

from maskwright import encode
from maskwright.operators.sealing import restore, rotate, seal, unseal

KEYS = [("a", b"0" * 16), ("b", b"1" * 32)]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(KEYS, "key_id string, key binary")


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(["x", "é ß", "", None, "long " * 300, "x"])], "id int, value string")


def by_id(df, column):
    return {r.id: r[column] for r in df.select("id", column).collect()}


def test_seal_rotate_unseal(spark, keys, values):
    sealed = seal(values, keys, "a").cache()
    got, plain = by_id(sealed, "sealed"), by_id(values, "value")
    assert got[3] is None and all(s.startswith("<a:") for i, s in got.items() if i != 3)
    assert got[0] != got[5]  # a nonce of its own each
    assert by_id(unseal(sealed, keys, into="back"), "back") == plain
    rotated = rotate(sealed, keys, "b").cache()
    assert all(s is None or s.startswith("<b:") for s in by_id(rotated, "sealed").values())
    assert by_id(unseal(rotated, keys, into="back"), "back") == plain
    only_a = keys.where("key_id = 'a'")
    assert set(by_id(unseal(rotated, only_a, into="back"), "back").values()) == {None}
    again = by_id(rotate(rotated, keys, "b"), "sealed")
    assert again == by_id(rotated, "sealed")  # those of the key stay


def test_errors_and_damage(spark, keys, values):
    with pytest.raises(Exception, match="no key"):
        seal(values, keys, "c").collect()
    damaged = spark.createDataFrame([(1, "<a:AAAA>"), (2, "<a:!!>"), (3, "<z:AAAA>"), (4, "none"), (5, None)], "id int, sealed string")
    assert set(by_id(unseal(damaged, keys), "value").values()) == {None}
    assert by_id(rotate(damaged, keys, "b"), "sealed") == by_id(damaged, "sealed")
    with pytest.raises(ValueError, match="key_id"):
        encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), keys=keys)


def test_texts_are_restored_and_plans_hold_no_key(spark, keys):
    docs = spark.createDataFrame([(1, "mail a@x.be en b@x.be, a@x.be"), (2, "<a:AAAA> en <b> blijft"), (3, None)], "doc_id long, text string")
    done = encode(docs, strategy="encrypt", keys=keys, key_id="b")
    texts = {r.doc_id: r.text for r in done.text.collect()}
    assert "@" not in texts[1] and texts[2] == "<a:AAAA> en <b> blijft" and done.mapping.count() == 2
    again = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in restore(again, keys).collect()} == {r.doc_id: r.text for r in docs.collect()}
    plan = done.text._jdf.queryExecution().toString()
    assert "1" * 32 not in plan and "31313131" not in plan.replace(" ", "")
