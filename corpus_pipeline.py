"""A cleaning pipeline over the documents table, ending in sampled SentencePiece encodings.

Each stage calls one operator of maskwright.llm and works on all that its predecessor kept. All but the last return the
columns of documents, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.cluster import shared_folder
from maskwright.llm.contamination import keep_clean
from maskwright.llm.line_dedup import drop_lines
from maskwright.llm.near_duplicates import keep_one
from maskwright.llm.pieces import encode_samples
from maskwright.llm.quality import keep_good
from maskwright.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 characters or more that five documents have, but in the last of these.

    n_chars, where it is there, is the new text's.
    """
    return drop_lines(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and two distinct sampled encodings of each document."""
    return encode_samples(docs, tokenizer_file("piece_bpe_32k.model"), k=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Compression ratios and sampled encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}-stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
