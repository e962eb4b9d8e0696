"""Staged tables leave no shuffle files on the executors' disks."""

import time

from maskwright.llm.cluster import staged


def _shuffles(spark) -> int:
    """Shuffles that the executors hold files of."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [blocks.apply(i).getName() for i in range(blocks.size())]
    return len({n.split("_")[1] for n in names if n.startswith("shuffle_")})


def test_a_staged_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffles(spark), spark.conf.get(name)
    rows = spark.range(5000).selectExpr("id", "id % 7 as k")
    tables = [staged(rows.repartition(5, "id").groupBy("k").count(), "counts") for _ in range(3)]
    assert [t.count() for t in tables[:1]] == [7] and {r["count"] for r in tables[2].collect()} <= {714, 715}
    for _ in range(50):  # files are deleted in the background
        if _shuffles(spark) <= before + 1:  # that of the count above
            break
        time.sleep(0.2)
    assert _shuffles(spark) <= before + 1
    assert spark.conf.get(name) == setting
