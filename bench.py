"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores).
Each query is written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from maskwright import build_mapping, decode, detect_all, encode, encode_each, sanitise
from maskwright.operators.detect import detect
from maskwright.operators.rewrite import kept_spans, prepare
from maskwright.plans import corpora
from maskwright.session import stage


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * (cores or 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "5g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = corpora.documents(spark, sf)
    notes = corpora.notes(spark, sf)
    rows: dict[str, float] = {}

    def run(name, make) -> None:
        started = time.time()
        make().write.format("noop").mode("overwrite").save()
        rows[name] = round(time.time() - started, 3)

    run("documents_detect_phone", lambda: detect(docs, "phone"))
    run("documents_detect_name", lambda: detect(docs, "name"))
    run("documents_detect_place", lambda: detect(docs, "place"))
    run("documents_detect_all", lambda: detect_all(docs))
    run("documents_redact", lambda: sanitise(docs, "redact"))
    run("documents_encode_corpus", lambda: encode(docs).text)
    run("notes_redact", lambda: sanitise(notes, "redact"))
    run("notes_encode_per_document", lambda: encode_each(notes))
    done = None

    def whole():
        nonlocal done
        done = encode(notes)
        return done.text

    run("notes_encode_corpus", whole)
    texts = stage(done.text, "texts")
    run("notes_decode", lambda: decode(texts, done.mapping))
    spans = stage(kept_spans(prepare(notes)), "spans")
    run("notes_mapping", lambda: build_mapping(spans))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(rows.values()), 3), "unit": "sec",
        "queries": rows, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
