"""Streams give what the same documents give as a batch."""

from maskwright import encode, sanitise
from maskwright.streaming.stream import MappingLog, encode_batch, encode_stream, sanitise_stream

SCHEMA = "doc_id bigint, text string"


def write_batches(spark, path):
    for n in range(3):
        rows = [(n * 10 + i, f"mail m{(n + i) % 4}@x.be van JANSSENS Jan") for i in range(5)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_stateless_stream(spark, tmp_path):
    batch = write_batches(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    (sanitise_stream(stream, "mask").writeStream.format("parquet").option("path", f"{tmp_path}/out")
     .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sanitise(batch, "mask").collect()))


def test_carried_mapping(spark, tmp_path):
    batch = write_batches(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    encode_stream(stream, f"{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    log = MappingLog(spark, f"{tmp_path}/map")
    whole = encode(batch)
    assert log.read(2).agg({"occurrences": "sum"}).first()[0] == whole.mapping.agg({"occurrences": "sum"}).first()[0]
    assert log.read(2).count() == whole.mapping.count()
    # one value keeps one placeholder over all batches
    assert {r.norm for r in log.read(0).collect()} <= {r.norm for r in log.read(2).collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()


def test_replayed_batch_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@x.be"), (2, "b@x.be")], SCHEMA)
    log = MappingLog(spark, f"{tmp_path}/map")
    run = encode_batch(log, f"{tmp_path}/out")
    run(docs.where("doc_id = 1"), 0)
    run(docs.where("doc_id = 2"), 1)
    first = sorted(map(str, log.read(1).collect()))
    run(docs.where("doc_id = 2"), 1)
    assert sorted(map(str, log.read(1).collect())) == first


def test_log_is_compacted_and_replayed(spark, tmp_path):
    texts = [f"mail m{i % 5}@x.be en n{i}@x.be" for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    log = MappingLog(spark, f"{tmp_path}/map", buckets=4, compact_every=2)
    run = encode_batch(log, f"{tmp_path}/out")
    for n in range(9):
        run(docs.where(f"doc_id = {n}"), n)
    whole = sorted(map(str, encode(docs).mapping.collect()))
    assert sorted(map(str, log.read(8).collect())) == whole
    assert log._batches("snapshot", 99) == [5, 7]  # older ones, and the changes before them, are gone
    assert log._batches("delta", 99) == [6, 7, 8]
    # what a batch wrote is what it was about
    assert {r.canonical for r in log._rows("delta", 8).collect()} == {"m3@x.be", "n8@x.be"}
    before = sorted(map(str, log.read(6).collect()))
    for n in (6, 7, 8):  # again, after a failure
        run(docs.where(f"doc_id = {n}"), n)
    assert sorted(map(str, log.read(8).collect())) == whole and sorted(map(str, log.read(6).collect())) == before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_empty_batches_keep_the_mapping(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@x.be")], SCHEMA)
    log = MappingLog(spark, f"{tmp_path}/map")
    run = encode_batch(log, f"{tmp_path}/out")
    run(docs, 0)
    run(docs.where("doc_id = 7"), 1)
    run(docs.withColumn("doc_id", docs.doc_id + 1), 2)
    assert [(r.placeholder, r.occurrences) for r in log.read(2).collect()] == [("EMAIL_001", 2)]
