import json

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import dataset as D
from sparkbars.operators import evaluate as V
from sparkbars.operators import model as M
from sparkbars.operators.ranks import quantiles
from sparkbars.plans.research import run_research
from tests.data import frame, walk


def scored(spark, score, target):
    return spark.createDataFrame(pd.DataFrame({"s": np.asarray(score, float), "t": np.asarray(target, float)}))


def test_p_value():
    # Two-sided p of a t statistic, from tables: t = 2.228 at 10 degrees of freedom is 0.05, t = 2.750 at 30 is 0.01.
    for t, dof, p in ((2.2281388, 10, 0.05), (2.7499957, 30, 0.01), (0.0, 10, 1.0)):
        r = t / np.sqrt(dof + t * t)
        assert V.correlation_p_value(r, dof + 2) == pytest.approx(p, rel=1e-5)
    assert V.correlation_p_value(1.0, 20) == 0.0
    assert 0 < V.correlation_p_value(0.02, 1_000_000) < 1e-80


def test_rank_ic_with_ties_and_gaps(spark):
    rng = np.random.default_rng(1)
    s, t = rng.integers(0, 8, 200).astype(float), rng.normal(size=200)
    t += s / 4
    t[:5], s[7] = np.nan, np.nan
    ok = ~(np.isnan(s) | np.isnan(t))
    want = np.corrcoef(pd.Series(s[ok]).rank(), pd.Series(t[ok]).rank())[0, 1]
    r = V.rank_ic(scored(spark, s, t), "s", "t").first()
    assert (r["n"], r["ic"], r["pass"]) == (194, pytest.approx(want), True)
    r = V.rank_ic(scored(spark, s[10:19], t[10:19]), "s", "t").first()
    assert (r["ic"], r["p_value"], r["pass"]) == (0.0, 1.0, False)


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(2).integers(0, 30, 173).astype(float)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles(scored(spark, x, x), "s", probs).first()["q"]
    np.testing.assert_allclose(got, np.quantile(x, probs))
    by = spark.createDataFrame(pd.DataFrame({"k": np.arange(173) % 3, "s": x}))
    for r in quantiles(by, "s", [0.5], ["k"]).collect():
        assert r["q"][0] == np.median(x[np.arange(173) % 3 == r["k"]])


@pytest.mark.parametrize("score", [np.arange(60) % 37, np.r_[np.zeros(40), np.arange(20)], np.arange(60) * 0.1])
def test_staircase_equals_pandas(spark, score):
    t = np.random.default_rng(3).normal(size=60)
    bins = pd.qcut(score, 5, labels=False, duplicates="drop")
    want = [t[bins == i].mean() if (bins == i).any() else 0.0 for i in range(5)]
    r = V.quantile_staircase(scored(spark, score, t), "s", "t").first()
    np.testing.assert_allclose(r["quantile_means"], want)
    assert r["spread"] == pytest.approx(want[-1] - want[0])
    few = V.quantile_staircase(scored(spark, score[:24], t[:24]), "s", "t").first()
    assert (few["quantile_means"], few["spread"], few["monotonic"]) == ([], 0.0, False)


def test_auc(spark):
    rng = np.random.default_rng(4)
    s, y = rng.integers(0, 6, 80).astype(float), rng.integers(0, 2, 80)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert V.auc_roc(scored(spark, s, y), "s", "t").first()["auc"] == pytest.approx(want)
    assert tuple(V.auc_roc(scored(spark, s, np.ones(80)), "s", "t").first()) == (0.5, False)
    assert V.auc_roc(scored(spark, s[:4], y[:4]), "s", "t").first()["auc"] == 0.5


def _events(n):
    return pd.DataFrame({"symbol": "X", "pos": np.arange(n) * 10, "event_time": np.arange(n) * 40_000_000})


@pytest.mark.parametrize("n,k,gap", [(60, 5, 3), (60, 5, 100), (23, 2, 0)])
def test_purged_folds(spark, n, k, gap):
    got = V.purged_folds(V.time_index(spark.createDataFrame(_events(n))), k, gap).toPandas()
    size = n // (k + 1)
    for i in range(k):
        start = (i + 1) * size
        train = max(size, start - min(gap, max(0, size - 1)))
        f = got[got.fold == i]
        assert sorted(f[f.role == "train"].row_index) == list(range(train))
        assert sorted(f[f.role == "validation"].row_index) == list(range(start, start + size))


def test_too_few_rows_for_folds(spark):
    with pytest.raises(Exception, match="not enough rows"):
        V.purged_folds(V.time_index(spark.createDataFrame(_events(9))), 5).count()


def test_gap_split_and_summary(spark):
    e = spark.createDataFrame(_events(11))
    assert V.event_gap(e, 35).first()["gap"] == 4
    assert V.event_gap(e.limit(1), 7).first()["gap"] == 7
    assert V.chronological_split(V.time_index(e), 0.8).filter("role = 'train'").count() == 8
    one = V.cv_summary(spark.createDataFrame([(0.05,)], "ic double")).first()
    assert (one["mean_ic"], one["std_ic"], one["pass"]) == (0.05, 0.0, True)


def test_empty_dataset_meta(spark):
    bars = frame(spark, walk(5, 30))
    data = D.build_dataset(bars.withColumn("atr_daily", F.lit(0.1)), F.lit(0), lambda df: {"f": F.lit(1.0)},
                           lambda b, e: e.select("symbol", "pos", *[F.lit(None).cast(t).alias(c) for c, t in (
                               ("label", "int"), ("barrier_hit", "string"), ("exit_idx", "long"), ("n_bars_held", "long"),
                               ("entry_price", "double"), ("exit_price", "double"), ("actual_return", "double"),
                               ("return_atr", "double"), ("truncated", "boolean"))]))
    assert data.count() == 0
    r = D.dataset_meta(data, bars).first()
    assert (r["n_events"], r["label_counts"], r["coverage"]) == (0, {}, 0)


def test_research_run(spark, tmp_path):
    walk(6, 1500).drop(columns=["symbol", "pos"]).to_parquet(tmp_path / "bars.parquet")
    cfg = {
        "data": {"source": str(tmp_path / "bars.parquet"), "symbol": "X"},
        "trigger": {"type": "breakout", "params": {"intensity_threshold": 0.0}},
        "indicators": {"entry_period": 20, "ma_period": 100, "daily_bars": 60},
        "features": [{"type": "atr"}, {"type": "breakout_intensity"}, {"type": "volume_ratio"}],
        "labeler": {"type": "fixed_horizon", "params": {"horizon": 20}},
        "model": {"target": "y_norm", "train_split": 0.7, "output_prefix": "trees", "params": {"maxIter": 3}},
    }
    out = run_research(spark, cfg, str(tmp_path / "out"))
    names = ["atr", "atr_pct", "long_intensity", "short_intensity", "vol_ratio", "vol_zscore"]
    n = out.meta.first()["n_events"]
    assert n > 50 and spark.read.parquet(str(tmp_path / "out/dataset")).count() == n
    meta = out.meta.first()
    assert meta["feature_names"] == names and json.loads(meta["config"])["trigger"]["type"] == "breakout"
    assert out.yearly.first()["events"] == n and out.ic.first()["n"] == n - int(n * 0.7)
    again = M.load_model(str(tmp_path / "out/trees"))
    assert M.model_features(again) == names == M.model_features(out.model)
    a = M.score(out.model, out.dataset).select(F.sum("score")).first()[0]
    assert M.score(again, out.dataset).select(F.sum("score")).first()[0] == pytest.approx(a)


def test_rows_of_one_day_are_spread(spark):
    """All rows share a time: they are still dealt out over many ranges, and numbered by symbol and position."""
    rows = spark.range(40_000).select(
        F.lit(1_700_000_000_000).alias("event_time"), F.concat(F.lit("S"), F.col("id") % 7).alias("symbol"), (F.col("id") * 37 % 40_000).alias("pos"))
    together = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, "false")  # the ranges of so few rows would be put together again
    try:
        out = V.time_index(rows)
    finally:
        spark.conf.unset(together)
    got = out.toPandas().sort_values("row_index")
    assert got.row_index.tolist() == list(range(40_000))
    assert got[["symbol", "pos"]].values.tolist() == sorted(got[["symbol", "pos"]].values.tolist())
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in out.inputFiles()]
    assert sum(sizes) == 40_000 and len(sizes) >= 4 and max(sizes) < 20_000
