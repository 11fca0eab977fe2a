"""Sweeps in which combinations fail while they run, hang, or cannot run at all."""

import time

import pytest
from pyspark.sql import functions as F

from sparkbars.plans import sweep as P
from tests.data import frame, walk


def counted(rows, i):
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("run_id", F.lit(i))


def target(bars, combos):
    @F.udf("boolean")
    def slow(pos):
        time.sleep(120)
        return True

    out = None
    for i, c in combos.items():
        rows = bars.filter(F.col("pos") < 10)
        if c["mode"] == "fails":
            rows = rows.filter(F.raise_error(F.lit("bad luck")).isNull())
        if c["mode"] == "hangs":
            rows = rows.filter(slow("pos"))
        out = counted(rows, i) if out is None else out.unionByName(counted(rows, i))
    return out


def test_failing_and_hanging_combinations_have_one_row_each(spark):
    bars = frame(spark, walk(2, 60))
    began = time.time()
    out = P.sweep(bars, {"mode": ["fast", "fails", "hangs", "slow"], "flag": True}, target, timeout=20)
    rows = {r["run_id"]: r for r in out.collect()}
    assert [rows[i]["mode"] for i in range(4)] == ["fast", "fails", "hangs", "slow"] and all(r["flag"] is True for r in rows.values())
    assert [rows[i]["n"] for i in range(4)] == [10, None, None, 10]
    assert rows[0]["error"] is None and "bad luck" in rows[1]["error"] and rows[2]["error"] == "timeout"
    assert time.time() - began < 110


def test_all_combinations_fail(spark):
    out = P.sweep(frame(spark, walk(2, 60)), {"mode": "fails"}, target).collect()
    assert len(out) == 1 and "bad luck" in out[0]["error"] and out[0]["mode"] == "fails"


@pytest.mark.parametrize("run", [P.sweep_backtest, P.sweep_dataset])
def test_a_grid_in_which_nothing_can_run_shows_its_errors(spark, run):
    out = run(frame(spark, walk(2, 60)), {"entry_period": [0, -1], "exit_period": 3}).collect()
    assert sorted(r["entry_period"] for r in out) == [-1, 0]
    assert {r["error"] for r in out} == {"entry_period must be at least 1"}
