"""Text files: one for each document, in and out."""

import os

import pytest

from maskwright import encode
from maskwright.operators import mapping as maps
from maskwright.session import small_files, stage, staged_tables, staging_dir
from maskwright.sources import files

ROWS = [("b.txt", "mail a@x.be"), ("a.txt", "geen"), ("c d.txt", ""), ("e.md", "naïef é\nregel 2")]


def write(spark, path, rows=ROWS, **options):
    files.write_text_files(spark.createDataFrame(rows, "name string, text string").repartition(3), str(path), **options)


def test_files_are_written_and_numbered_by_path(spark, tmp_path):
    write(spark, tmp_path / "in")
    assert sorted(os.listdir(tmp_path / "in")) == ["a.txt", "b.txt", "c d.txt", "e.md"]  # nothing of the attempts is left
    assert (tmp_path / "in" / "e.md").read_bytes() == "naïef é\nregel 2".encode()
    texts = files.read_texts(spark, f"{tmp_path}/in")
    got = {r.doc_id: (r.path.rsplit("/", 1)[1], r.text) for r in texts.collect()}
    assert got == dict(enumerate(sorted(r for r in ROWS if r[1]), 1))  # files of no bytes are no documents
    names = {r.sanitized_name for r in files.output_names(texts).collect()}
    assert {"a_sanitized.txt", "e_sanitized.md"} <= names


def test_other_encodings(spark, tmp_path):
    write(spark, tmp_path / "in", [("a.txt", "café")], encoding="latin-1")
    assert (tmp_path / "in" / "a.txt").read_bytes() == b"caf\xe9"
    assert [r.text for r in files.read_texts(spark, f"{tmp_path}/in", "ISO-8859-1").collect()] == ["café"]


def test_modes_and_refused_names(spark, tmp_path):
    write(spark, tmp_path / "in")
    write(spark, tmp_path / "in", [("z.txt", None)])
    assert len(os.listdir(tmp_path / "in")) == 5
    write(spark, tmp_path / "in", [("y.txt", "new")], mode="overwrite")
    assert os.listdir(tmp_path / "in") == ["y.txt"]
    for bad in ([("../x.txt", "t")], [("_x.txt", "t")], [(None, "t")], [("same.txt", "1"), ("same.txt", "2")]):
        with pytest.raises(Exception, match="file name"):
            write(spark, tmp_path / "in", bad)
    # a failed write leaves what was there, and nothing else that a reader sees
    assert [n for n in os.listdir(tmp_path / "in") if n[0] != "_"] == ["y.txt"]
    assert files.read_texts(spark, f"{tmp_path}/in").count() == 1


def test_staged_tables_are_deleted_by_their_owner(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@x.be"), (2, "mail b@x.be en a@x.be")], "doc_id long, text string")
    folder = staging_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    with staged_tables():
        stage(docs, "kept")
        done = encode(docs)
        done.text.write.parquet(f"{tmp_path}/texts")
        done.mapping.write.parquet(f"{tmp_path}/mapping")
        assert len(set(os.listdir(folder)) - before) > 2
    assert set(os.listdir(folder)) <= before
    assert spark.read.schema(maps.SCHEMA).parquet(f"{tmp_path}/mapping").count() == 2


def test_small_files_share_tasks(spark, tmp_path):
    """Files of a few bytes are not read 32 a task; session settings stay as they were."""
    for i in range(400):
        (tmp_path / f"{i:03d}.txt").write_text(f"text {i}")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with small_files(spark):
        assert spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() <= 8
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    got = {r.doc_id: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {i + 1: f"text {i}" for i in range(400)}
