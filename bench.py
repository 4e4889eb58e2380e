"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

NAMES = (
    "budgeted_expansion", "expand_capped", "variable_length", "topk_cosine", "topk_by_label", "hydrate_ranked", "conflict_resolution", "as_of_owner", "link_resolution", "in_degree_histogram",
    "upsert_nodes", "speaker_runs", "chat_parse", "eval_summary", "pricing_summary",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from quillgraph import queries, ship
    from quillgraph.sources.tables import stored_graph, stored_vectors

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    found, took = queries.queries(), {}
    setup = {}
    for f in (stored_graph, stored_vectors):  # queries read the graph and the vectors from there
        t = time.time()
        f(spark, sf)
        setup[f.__name__] = round(time.time() - t, 3)
    for name in NAMES:
        times = []
        for _ in range(2):  # the second run is warm
            t = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(min(times), 3)
    total = sum(took.values())
    print(json.dumps({"metric": "total_query_seconds", "value": round(total, 3), "unit": "sec", "queries": took, "sf": Path(sf).name, "setup": setup, "with_setup": round(total + sum(setup.values()), 3)}))


if __name__ == "__main__":
    main()
