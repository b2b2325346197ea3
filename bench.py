"""Times the headline queries on the tables of $BENCH_SF_DIR, on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from asofloom import tuned  # noqa: E402
from asofloom.queries import QUERIES  # noqa: E402
from asofloom.queries.structure import all_aggregations  # noqa: E402

HEADLINE = [
    "spine_customer_orders", "spine_depth_3", "join_asof_grace", "agg_gap_mean", "agg_gini", "agg_entropy", "agg_markov_conditional_entropy", "agg_kl_drift", "agg_trimmed_mean_10",
    "xf_rolling_median_7", "xf_ema_7", "xf_cross_entity_percentile", "graph_degree", "graph_clustering", "peers", "spatial_suppliers_near", "neighbours_undirected", "bridge_markov_surprisal", "bridge_sentiment",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    scratch = tempfile.mkdtemp(prefix="asofloom-bench-")
    spark = tuned(builder.config("spark.checkpoint.dir", scratch), cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["spine_customer_orders"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took = {}
    shape = {}
    for name, query in ({n: QUERIES[n] for n in HEADLINE} | {"all_aggregations": all_aggregations}).items():
        began = time.time()
        df = query(spark, sf_dir)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        shape[name] = [seen.get["rows"], len(df.columns)]
        print(name, took[name], *shape[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_columns": shape, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
