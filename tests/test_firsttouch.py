import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators.firsttouch import first_touch
from sparkbars.operators.labels import label_fixed_horizon, label_triple_barrier
from tests.data import frame, walk


def _path(prices, spread=0.0):
    """Bars from (high, low, close) triples."""
    return pd.DataFrame([
        {"symbol": "X", "pos": i, "high": float(h), "low": float(lo), "close": float(c)} for i, (h, lo, c) in enumerate(prices)
    ])


def _label(spark, bars, side=1, horizon=3, at=0, **kw):
    b = frame(spark, bars)
    events = frame(spark, bars[bars.pos == at].assign(side=side, atr=1.0))
    args = {"upper_barrier": 0.02, "lower_barrier": -0.01, "horizon": horizon, **kw}
    return label_triple_barrier(b, events, **args).first().asDict()


FLAT = (100.5, 99.5, 100.0)


@pytest.mark.parametrize("path,side,label,hit,exit_idx,truncated", [
    ([FLAT, FLAT, (102.5, 99.9, 102), FLAT], 1, 1, "upper", 2, False),
    ([FLAT, (100.5, 98.5, 99), (103, 99, 102), FLAT], 1, -1, "lower", 1, False),
    ([FLAT, (103, 98, 100), FLAT, FLAT], 1, -1, "lower", 1, False),
    ([FLAT, FLAT, FLAT, FLAT], 1, 0, "timeout", 3, False),
    ([FLAT, FLAT], 1, 0, "timeout", 1, True),
    ([FLAT, (100.2, 97.9, 98), FLAT, FLAT], -1, 1, "upper", 1, False),
    ([FLAT, (101.1, 99, 101), FLAT, FLAT], -1, -1, "lower", 1, False),
])
def test_hand_built_paths(spark, path, side, label, hit, exit_idx, truncated):
    r = _label(spark, _path(path), side)
    assert (r["label"], r["barrier_hit"], r["exit_idx"], r["truncated"]) == (label, hit, exit_idx, truncated)
    change = np.log(path[exit_idx][2] / 100.0)
    assert r["actual_return"] == pytest.approx(change * side)


def test_last_bar_event(spark):
    r = _label(spark, _path([FLAT, FLAT]), at=1)
    assert (r["n_bars_held"], r["label"], r["exit_price"], r["truncated"]) == (0, 0, 100.0, True)


def test_atr_barriers_and_missing_atr(spark):
    bars = _path([FLAT, (100.4, 98.9, 99), FLAT, FLAT])
    r = _label(spark, bars, upper_barrier=2.0, lower_barrier=-1.0, barrier_mode="atr")
    assert (r["label"], r["return_atr"]) == (-1, pytest.approx(-1.0))
    b = frame(spark, bars)
    events = frame(spark, bars[bars.pos == 0].assign(side=1, atr=np.nan))
    r = label_triple_barrier(b, events, 2.0, -1.0, 2, "atr").first()
    assert (r["label"], r["return_atr"]) == (0, pytest.approx(0.0))


@pytest.mark.parametrize("kw", [dict(upper_barrier=0), dict(lower_barrier=0.1), dict(barrier_mode="x")])
def test_bad_barriers(spark, kw):
    with pytest.raises(ValueError):
        _label(spark, _path([FLAT, FLAT]), **kw)


def test_first_touch_equals_scan(spark):
    rng = np.random.default_rng(11)
    pdf = pd.concat([walk(21, 400, "A"), walk(22, 300, "B")])
    rows = []
    for i in range(400):
        symbol = "AB"[i % 2]
        n = 400 if symbol == "A" else 300
        a = int(rng.integers(0, n))
        close = pdf[(pdf.symbol == symbol) & (pdf.pos == a)].close.iloc[0]
        rows.append({
            "id": i, "symbol": symbol, "a": a + 1, "z": a + int(rng.integers(-2, 350)),
            "up": close + rng.exponential(8) if rng.random() < 0.8 else np.nan,
            "down": close - rng.exponential(8) if rng.random() < 0.8 else np.nan,
        })
    probes = pd.DataFrame(rows)
    # Several ranges share a start and levels but not an end.
    probes = pd.concat([probes, probes.assign(id=probes.id + 1000, z=probes.z - 40)])
    for sizes in (dict(), dict(fan_bits=3), dict(fan_bits=1), dict(fan_bits=2, longest=400)):
        got = first_touch(frame(spark, probes), frame(spark, pdf), "a", "z", "up", "down", **sizes).toPandas()
        assert len(got) == len(probes)
        for r in got.itertuples():
            d = pdf[(pdf.symbol == r.symbol) & (pdf.pos >= r.a) & (pdf.pos <= r.z)]
            hit = d[(d.high >= r.up) | (d.low <= r.down)]
            if hit.empty:
                assert pd.isna(r.touch_pos)
            else:
                h = hit.iloc[0]
                assert (r.touch_pos, r.touch_up, r.touch_down) == (h.pos, h.high >= r.up, h.low <= r.down)


def test_far_touch_opens_a_bounded_number_of_rows(spark):
    """A touch after 200,000 bars and none at all: the exploded rows are bounded by the levels, not by the range."""
    n = 200_000
    bars = spark.range(n).select(F.lit("X").alias("symbol"), F.col("id").alias("pos"), F.when(F.col("id") == n - 7, 200.0).otherwise(101.0).alias("high"), F.lit(99.0).alias("low"))
    ask = [(i, "X", i, n - 1, 150.0, None) for i in range(0, 60)] + [(100, "X", 5, n - 8, 150.0, None), (101, "X", 9, n - 1, None, 1.0)]
    probes = spark.createDataFrame(ask, "id int, symbol string, a long, z long, up double, down double")
    got = {r["id"]: (r["touch_pos"], r["touch_up"], r["touch_down"]) for r in first_touch(probes, bars, "a", "z", "up", "down").collect()}
    assert got == {i: (n - 7, True, False) if i < 60 else (None, None, None) for i in [*range(60), 100, 101]}


def test_fixed_horizon(spark):
    pdf = walk(31, 50).assign(atr_daily=0.01)
    pdf.loc[pdf.pos == 10, "atr_daily"] = np.nan
    events = pdf[pdf.pos.isin([5, 10, 45, 49])].assign(side=[1, -1, 1, -1])
    got = label_fixed_horizon(frame(spark, pdf), frame(spark, events), 8).toPandas().set_index("pos")
    close = pdf.close.to_numpy()
    for pos, side in zip((5, 10, 45, 49), (1, -1, 1, -1)):
        end = min(pos + 8, 49)
        raw = side * (close[end] - close[pos]) / close[pos]
        assert got.at[pos, "raw_return"] == pytest.approx(raw)
        assert got.at[pos, "y_norm"] == pytest.approx(raw / (1.0 if pos == 10 else 0.01))
        assert got.at[pos, "truncated"] == (pos + 8 >= 50)
