"""Headline benchmark: run the main queries at $BENCH_SF_DIR and print one JSON line.

Each query is executed to completion with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lineitem_profile",
    "column_types",
    "sample_mixed",
    "serialize_header_values_verbose",
    "cosine_topk",
    "embedding_mrr",
    "ranking_metrics",
    "ngram_cosine_topk",
    "match_tables",
    "match_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPARK_MASTER", f"local[{cpus}]")
    from colweave.session import get_spark
    from colweave.plans.registry import registry

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = registry()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    # warm-up: JVM, codegen and Python workers
    reg["column_catalog"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    li_rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    extra = {}
    if times.get("lineitem_profile"):
        extra["lineitem_cells_per_sec"] = round(li_rows * 11 / times["lineitem_profile"])
    if times.get("cosine_topk"):
        n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        extra["vector_pairs_per_sec"] = round(n * (n - 1) / times["cosine_topk"])
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        **extra,
    }))


if __name__ == "__main__":
    main()
