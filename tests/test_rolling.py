import numpy as np
import pandas as pd
import pytest

from sparkbars.operators.indicators import add_channels, add_indicators
from sparkbars.operators.rolling import Roll, halo_frame
from tests.data import frame, walk


def _pandas(pdf, p):
    out = []
    for _, d in pdf.groupby("symbol"):
        d = d.sort_values("pos").reset_index(drop=True)
        o = d.copy()
        before = lambda s, k, how: getattr(s.rolling(k), how)().shift(1)
        o["entry_high"] = before(d.high, p["entry_period"], "max")
        o["entry_low"] = before(d.low, p["entry_period"], "min")
        o["exit_high"] = before(d.high, p["exit_period"], "max")
        o["exit_low"] = before(d.low, p["exit_period"], "min")
        pc = d.close.shift(1)
        o["tr"] = pd.concat([d.high - d.low, (d.high - pc).abs(), (d.low - pc).abs()], axis=1).max(axis=1)
        o["atr"] = before(o.tr, p["atr_period"], "mean")
        o["vol_ma"] = before(d.volume, p["vol_period"], "mean")
        lv = np.log(d.volume.replace(0, np.nan))
        o["vol_zscore"] = (lv - before(lv, p["vol_period"], "mean")) / lv.rolling(p["vol_period"]).std(ddof=0).shift(1)
        o["ma"] = before(d.close, p["ma_period"], "mean")
        o["atr_daily"] = (o.atr / d.close).rolling(p["daily_bars"]).mean()
        o["taker_buy_ratio"] = before(d.taker_buy_base, p["vol_period"], "sum") / before(d.volume, p["vol_period"], "sum")
        o["ret_10"] = d.close / d.close.shift(10) - 1
        out.append(o)
    return pd.concat(out).reset_index(drop=True)


COLUMNS = ["entry_high", "entry_low", "exit_high", "exit_low", "tr", "atr", "vol_ma", "vol_zscore", "ma", "atr_daily",
           "taker_buy_ratio", "ret_10"]
SHORT = dict(entry_period=20, exit_period=10, atr_period=14, vol_period=20, ma_period=50, daily_bars=60)
LONG = dict(entry_period=100, exit_period=70, atr_period=90, vol_period=80, ma_period=128, daily_bars=77)
ODD = dict(entry_period=1, exit_period=2, atr_period=65, vol_period=66, ma_period=999, daily_bars=100)


@pytest.mark.parametrize("periods,chunk", [(SHORT, None), (SHORT, 120), (LONG, None), (LONG, 90), (ODD, 256)])
def test_indicators_equal_pandas(spark, periods, chunk):
    pdf = pd.concat([walk(1, 500, "A"), walk(2, 430, "B")])
    pdf.loc[(pdf.symbol == "A") & pdf.pos.isin([33, 200, 201]), ["close", "volume"]] = np.nan
    want = _pandas(pdf, periods)
    got = add_indicators(frame(spark, pdf), chunk_rows=chunk, **periods).toPandas()
    got = got.sort_values(["symbol", "pos"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in COLUMNS:
        pd.testing.assert_series_equal(got[c], want[c], check_names=False, rtol=1e-9, atol=1e-9)


def test_doubled_windows_equal_plain_frames(spark):
    rng = np.random.default_rng(5)
    pdf = walk(3, 300)
    pdf.loc[rng.choice(300, 6, replace=False), "close"] = np.nan
    bars = frame(spark, pdf)
    rolls = [
        Roll(f"{how}_{p}_{int(cur)}", how, "close", p, cur)
        for how in ("max", "min", "sum", "avg", "std") for p in (1, 2, 3, 7, 31, 64, 299, 400) for cur in (False, True)
    ]
    plain = halo_frame(bars, 401).roll(rolls, plain_limit=10_000).core().toPandas().sort_values("pos")
    doubled = halo_frame(bars, 401, 150).roll(rolls, plain_limit=0).core().toPandas().sort_values("pos")
    for r in rolls:
        np.testing.assert_allclose(
            doubled[r.out].astype(float), plain[r.out].astype(float), rtol=1e-9, atol=1e-7, err_msg=r.out)


def test_no_lookahead(spark):
    """A row does not change when later bars are cut off."""
    pdf = walk(7, 260)
    full = add_indicators(frame(spark, pdf), **LONG).toPandas().set_index("pos")
    for i in (130, 201, 259):
        part = add_indicators(frame(spark, pdf[pdf.pos <= i]), **LONG).toPandas().set_index("pos")
        for c in COLUMNS:
            np.testing.assert_allclose(float(part.at[i, c]), float(full.at[i, c]), rtol=1e-12, err_msg=c)


def test_warm_up_is_null_and_constant_volume_has_no_zscore(spark):
    pdf = walk(8, 120).assign(volume=10.0)
    got = add_indicators(frame(spark, pdf), **SHORT).toPandas().set_index("pos").sort_index()
    assert got["entry_high"].isna().sum() == 20 and got["atr"].isna().sum() == 14
    assert got["vol_zscore"].isna().all()
    assert (got["vol_ratio"].dropna() == 1).all()
    assert (got.loc[:19, "channel_pos"] == 0.5).all()
    long = add_indicators(frame(spark, pdf), **{**SHORT, "vol_period": 70}).toPandas()
    assert long["vol_zscore"].isna().all()


def test_channels_of_several_periods(spark):
    pdf = walk(9, 400)
    got = add_channels(frame(spark, pdf), [20, 80], [10, 40], [80, 5], chunk_rows=170).toPandas().sort_values("pos")
    for p in (10, 20, 40, 80):
        np.testing.assert_array_equal(got[f"high_{p}"], pdf.high.rolling(p).max().shift(1))
    np.testing.assert_array_equal(got["prev_close"], pdf.close.shift(1))


def test_long_windows_share_one_shuffle(spark):
    plan = add_channels(frame(spark, walk(1, 50)), [200, 300], [100], [200])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
