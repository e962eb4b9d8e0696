"""The pipeline, stage by stage, each held against brute force on what its predecessor kept."""

from __future__ import annotations

import re

from test_operators import LOW, near_reference

import corpus_pipeline
from maskwright.llm.quality import quality


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path)
    items = [(1, "never in any document at all is this sentence of more than ten words"), (2, None)]
    leak = source.where("length(text) > 2000").orderBy("doc_id").first()
    items.append((3, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", leak.text.translate(LOW))[20:40])))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (leak.doc_id + 10_000, leak.text, "en", "s", 1)],
                                  source.schema)
    source.union(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, results = docs, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in kept.collect()]
        stage(spark, kept, folder).write.parquet(f"{folder}/{number}")
        good = {r.doc_id for r in quality(kept).where("kept").collect()} if number == 0 else None
        kept = spark.read.parquet(f"{folder}/{number}")
        after = {r[0]: tuple(r) for r in kept.collect()}
        results[name] = set(after)
        if number < 4:
            assert kept.columns == docs.columns
        if number == 0:
            assert set(after) == good and {9000, 9001}.isdisjoint(after)
            assert all(after[r[0]] == r for r in before if r[0] in after)
        if number == 1:
            holders = {}
            for r in before:
                for line in r[1].split("\n"):
                    key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
                    if len(key) >= 40:
                        holders.setdefault(key, set()).add(r[0])
            for r in before:
                text = "\n".join(x for x in r[1].split("\n") if len(
                    h := holders.get(x.strip(" \t\n\x0b\x0c\r").translate(LOW), ())) < 5 or r[0] == max(h))
                assert after[r[0]][1] == text
        if number == 2:
            want = near_reference(before, 5, 80)
            assert set(after) == {d for d, s in want.items() if {k for _, _, k in s} == {True}} and len(after) < len(before)
        if number == 3:
            assert leak.doc_id in results["near duplicates"] and leak.doc_id not in after
        if number == 4:
            assert set(after) == {r[0] for r in before}
            assert all(r.decoded and 1 <= len(r.samples) <= 2 for r in kept.collect())
    ran = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in ran.collect()} == set(after) and ran.columns == kept.columns
