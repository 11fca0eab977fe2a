"""Times the headline queries and prints one JSON line.

Every query is built from the tables and written to a sink that keeps nothing. Each
is run once to warm up and then timed on a freshly built plan. ``value`` is their sum. The sweep of 48 parameter sets over
2.1 million bars is timed once, per set, and is not part of the sum.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from sparkbars import build_session, cut
from sparkbars.catalog import load
from sparkbars.operators.running import Running, range_index, running
from sparkbars.plans.sweep import expand_grid, sweep_backtest

HEADLINE = [
    "bars_daily",
    "bars_hourly",
    "features_every_bar",
    "trigger_breakout",
    "label_triple_pct",
    "ml_dataset",
    "rank_ic",
    "trades",
    "run_metrics",
    "sweep_backtest",
    "sweep_dataset",
    "sweep_accounts",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


SWEEP_BARS = 2_100_000
SWEEP_GRID = {"entry_period": [14400, 28800, 43200, 57600], "atr_mult": [3.0, 4.0, 5.0, 6.0], "intensity_threshold": [0.0, 0.5, 1.0]}


def long_history(spark, sf_dir: str):
    """One symbol of 2.1 million one-minute bars: every order line makes a few steps of a walk."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    copies = -(-SWEEP_BARS // max(lines.count(), 1))
    steps = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hashed = lambda n: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "k", F.lit(n)), F.lit(2001)) / 100.0
    order = F.xxhash64("l_orderkey", "l_linenumber", "k").alias("order")
    rows = range_index(steps.select(order, (hashed(0) - 10).alias("step"), hashed(1).alias("up"), hashed(2).alias("down")), ["order"], "pos")
    rows = rows.filter(F.col("pos") < SWEEP_BARS).withColumns({"symbol": F.lit("X"), "_chunk": F.col("pos") / 65_536})
    rows = rows.withColumn("_chunk", F.floor("_chunk"))
    level = running(rows, ["symbol"], "_chunk", "pos", [Running("close", "sum", F.col("step"))])
    price = F.col("close") + 100_000.0
    return cut(level.select(
        "symbol", "pos", (F.lit(1_577_836_800_000) + F.col("pos") * 60_000).alias("open_time"), price.alias("close"),
        (price + F.col("up")).alias("high"), (price - F.col("down")).alias("low"),
    ))


def seconds_per_set(spark, sf_dir: str) -> float:
    """48 coupled parameter sets over that history, from bars to ranked metrics, once and cold."""
    bars = long_history(spark, sf_dir)
    start = time.perf_counter()
    sweep_backtest(bars, SWEEP_GRID, rank_by="score", couple=True).write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - start) / len(expand_grid(SWEEP_GRID))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    spark = build_session("sparkbars-bench", cpus)
    seconds = {}
    for name in HEADLINE:
        timed(queries[name], spark, sf_dir)
        seconds[name] = round(timed(queries[name], spark, sf_dir), 3)
    per_set = round(seconds_per_set(spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total_warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {**seconds, "sweep_2_1m_bars_per_set": per_set},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
