"""Rows with much work each are dealt over tasks by their number, whatever their bytes."""

import datetime

import pytest
from pyspark.sql import functions as F

from maskwright import session
from maskwright.operators import external as ext
from maskwright.operators import resolve
from maskwright.plans import corpora, queries


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    day = datetime.date(1995, 3, 4)
    orders = spark.createDataFrame([(i, i % 10, "O", day) for i in range(2000)],
                                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date")
    orders.repartition(40).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(10)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("broadcast", [True, False])
def test_notes_grow_by_tasks(spark, tables, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        sizes = corpora.notes(spark, tables).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(sizes) > 80 and max(r["count"] for r in sizes) < 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_streamed_notes_are_dealt(spark, tables):
    plan = queries._note_stream(spark, tables)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan


def test_entities_make_no_notes_below_the_dealing(spark, tables):
    """Tests of a note or of its entities stay above the dealing, else undealt tasks make every note."""
    found = ext.ner_spans(corpora.entities(spark, tables))
    plan = found._jdf.queryExecution().optimizedPlan()
    below = []

    def walk(node, dealt):
        if dealt:
            below.append(node.verboseString(1000))
        dealt = dealt or node.nodeName() == "RepartitionByExpression"
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), dealt)

    walk(plan, False)
    assert below and not any("concat(" in node for node in below)
    assert found.where("doc_id = 9").count() == 0  # a note without entities
    assert found.where("doc_id = 1").count() > 0


def test_documents_of_one_block_are_resolved_without_joining_blocks(spark, monkeypatch):
    asked = []
    whole = resolve.islands

    def islands(spans, *rest):
        asked.extend(r.doc_id for r in spans.select("doc_id").distinct().collect())
        return whole(spans, *rest)

    monkeypatch.setattr(resolve, "islands", islands)
    rows = [(1, 0, 4, 0.9, 0), (1, 2, 8, 0.95, 1), (1, 7, 9, 0.8, 2), (2, 3, 12, 0.9, 0), (2, 11, 13, 0.8, 1), (2, 13, 15, 0.9, 2),
            (3, 40, 44, 0.9, 0), (None, 0, 4, 0.9, 0)]
    spans = spark.createDataFrame(rows, "doc_id bigint, start int, end int, confidence double, ord int")
    kept = sorted((r.doc_id, r.start) for r in resolve.resolve_spans(spans, block=10).collect())
    assert kept == [(1, 2), (2, 3), (2, 13), (3, 40)]
    assert sorted(asked) == [2, 3]
