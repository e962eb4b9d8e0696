"""Encryption with keys from a table.

A sealed value is ``<key id:base64>``, AES-GCM under the key of that id. Keys (``key_id`` string, ``key`` binary of 16, 24
or 32 bytes, one row an id) come by a join, so they are in no plan's text, and values sealed under several keys can lie
side by side while one key is replaced by another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import lit, u
from maskwright.operators.decode import fill_in
from maskwright.operators.joins import attach

TOKEN = u(r"<[A-Za-z0-9_.\-]+:[A-Za-z0-9+/]+=*>")
_PARTS = r"^<([^:]+):([^>]+)>$"


def seal(values: DataFrame, keys: DataFrame, key_id: str, column: str = "value", into: str = "sealed") -> DataFrame:
    """Add ``into``: the values of ``column`` under one key. Null stays null; an id without a key is an error."""
    one = keys.where(F.col("key_id") == key_id).select(F.lit(0).alias("_one"), F.col("key").alias("_key")).limit(1)
    known = one.groupBy().agg(F.first("_key").alias("_key")).withColumn("_one", F.lit(0))  # one row, null without the key
    keyed = values.withColumn("_one", F.lit(0)).join(F.broadcast(known), "_one")
    key = F.when(F.col("_key").isNull(), F.raise_error(F.lit(f"no key {key_id!r}"))).otherwise(F.col("_key"))
    cipher = F.base64(F.aes_encrypt(F.col(column).cast("binary"), key, F.lit("GCM")))
    return keyed.withColumn(into, F.concat(F.lit(f"<{key_id}:"), cipher, F.lit(">"))).drop("_one", "_key")


def unseal(values: DataFrame, keys: DataFrame, column: str = "sealed", into: str = "value") -> DataFrame:
    """Add ``into``: what was sealed; null where the key is unknown or the cipher is not of that key."""
    named = values.withColumn("_key_id", F.regexp_extract(column, _PARTS, 1))
    of = keys.select(F.col("key_id").alias("_key_id"), F.col("key").alias("_key"))
    cipher = F.expr(f"try_to_binary(regexp_extract({column}, {lit(_PARTS)}, 2), 'base64')")
    plain = F.try_aes_decrypt(cipher, F.col("_key"), F.lit("GCM")).cast("string")
    return named.join(of, "_key_id", "left").withColumn(into, plain).drop("_key_id", "_key")


def rotate(values: DataFrame, keys: DataFrame, key_id: str, column: str = "sealed") -> DataFrame:
    """The values of ``column`` under another key. Those that cannot be unsealed, or have that key, stay as they are."""
    opened = seal(unseal(values, keys, column, "_plain"), keys, key_id, "_plain", "_again")
    there = F.col(column).startswith(f"<{key_id}:")
    return opened.withColumn(column, F.when(there, F.col(column)).otherwise(F.coalesce("_again", column))).drop("_plain", "_again")


def restore(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts with every sealed value that a key opens put back; doc_id, text.

    Only the distinct values of each document meet the keys; the text is joined once with what they open.
    """
    tokens = docs.select("doc_id", F.explode_outer(F.expr(
        f"array_distinct(regexp_extract_all(text, {lit(TOKEN)}, 0))")).alias("token")).where(F.col("token").isNotNull())
    found = unseal(tokens, keys, "token", "value").where(F.col("value").isNotNull())
    filled = attach(docs.select("doc_id", "text"), found, "doc_id", "pairs", F.struct("token", "value"))
    return filled.select("doc_id", F.expr(fill_in("text", "pairs", lit(TOKEN))).alias("text"))
