"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from pathloom.plans.catalog import QUERIES
from pathloom.plans.engine import replay_engines
from pathloom.sources import views


def engines_200(spark, sf):
    """The first 200 operations under all engines, as published runs have it; the registered query takes the whole log."""
    g = views.flow(spark, sf)
    return replay_engines(g, views.optrace(spark, sf, g).where("op_seq < 200"))


HEADLINE = ["sssp_flow", "sssp_flow_all_sources", "sssp_trade_all_pairs", "p2p_distance", "trace_replay_answers", "increase_repair", "subtree_sizes", "lru_hits_misses", "latency_nearest_rank", "paired_speedups", "graph_edges_supply"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:  # one machine: its own folder is seen by all
        conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}"}
        spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        spark.range(1000).selectExpr("sum(id)").collect()
        took = {}
        for name, query in [*((n, QUERIES[n]) for n in HEADLINE), ("engines_200", engines_200)]:
            began = time.time()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
