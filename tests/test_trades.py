"""Backtests against a plain bar-by-bar loop."""

import math

import numpy as np
import pandas as pd
import pytest

from sparkbars.functions.sizing import scalar_vol_target_size
from sparkbars.operators.equity import drawdown, equity_curve
from sparkbars.operators.trades import Run, run_signals, select_trades, successors, trade_candidates
from sparkbars.plans.sweep import backtest, channel_table, runs_of, sweep_backtest
from tests.data import frame, walk


def loop(d: pd.DataFrame, run: Run, capital=10_000.0, cost=0.0005, per_year=525_600, stop_fill=False, sizer=None):
    """One bar at a time; points of skipped entries are left out of the curve."""
    close, high, low = (d[c].to_numpy() for c in ("close", "high", "low"))
    eh, el = d.high.rolling(run.entry_period).max().shift(1), d.low.rolling(run.entry_period).min().shift(1)
    xh, xl = d.high.rolling(run.exit_period).max().shift(1), d.low.rolling(run.exit_period).min().shift(1)
    pc = d.close.shift(1)
    tr = pd.concat([d.high - d.low, (d.high - pc).abs(), (d.low - pc).abs()], axis=1).max(axis=1)
    atr = tr.rolling(run.atr_period).mean().shift(1).to_numpy()
    start, curve, done, held = capital, [capital], [], None
    for i in range(run.warmup, len(d)):
        unit = atr[i] if atr[i] > 0 else 1.0
        up, down = (close[i] - eh[i]) / unit, (el[i] - close[i]) / unit
        go_long = close[i] > eh[i] and up > run.intensity_threshold
        go_short = close[i] < el[i] and down > run.intensity_threshold
        entry = -1 if go_short else 1 if go_long else 0
        leave = {1: close[i] < xl[i] and not entry, -1: close[i] > xh[i] and not entry}
        if held is None:
            if entry:
                stop = close[i] - entry * atr[i] * run.atr_mult
                if sizer:
                    size = sizer(capital, close[i], stop, atr[i], run.atr_mult)
                else:
                    risk = abs(close[i] - stop)
                    size = 0.0
                    if risk > 0 and capital > 0:
                        size = math.floor(min(capital * 0.02 / risk, capital * 20 / close[i]) * 1000) / 1000
                if size <= 0:
                    continue
                held = (entry, close[i], stop, size, i)
        else:
            side, price, stop, size, at = held
            touched = low[i] <= stop if side == 1 else high[i] >= stop
            out = None
            if touched:
                out = stop if stop_fill else (min if side == 1 else max)(close[i], stop)
            elif leave[side]:
                out = close[i]
            if out is not None:
                pnl = side * (out - price) * size - cost * (price + out) * size
                capital += pnl
                done.append((at, i, side, price, out, size, pnl, "stop" if touched else "signal"))
                held = None
        value = held[0] * (close[i] - held[1]) * held[3] if held else 0.0
        curve.append(capital + value)
    curve = np.array(curve)
    ret = np.diff(curve[run.warmup:]) / curve[run.warmup:-1]
    std = ret.std(ddof=1) if len(ret) > 1 else 0.0
    peak = np.maximum.accumulate(curve)
    pnls = np.array([t[6] for t in done])
    lost = -pnls[pnls < 0].sum()
    return {
        "trades": done, "curve": curve, "final_capital": capital,
        "sharpe": ret.mean() / std * np.sqrt(per_year) if std > 0 else 0.0,
        "max_dd_pct": abs(((curve - peak) / peak * 100).min()), "total_return_pct": (curve[-1] / start - 1) * 100,
        "n_trades": len(done), "win_rate": (pnls > 0).mean() if done else 0.0,
        "profit_factor": 0.0 if not done else pnls[pnls > 0].sum() / lost if lost > 0 else np.inf,
        "avg_bars_held": np.mean([t[1] - t[0] for t in done]) if done else 0.0,
        "total_fees": sum(cost * (t[3] + t[4]) * t[5] for t in done),
    }


RUNS = [Run(0, 20, 10, 20, 2.0, 0.0), Run(1, 10, 5, 8, 3.0, 0.5), Run(2, 6, 40, 70, 8.0, 0.0), Run(3, 5, 80, 5, 100.0, 0.0)]
BARS = pd.concat([walk(41, 900, "A"), walk(42, 700, "B", step=3.0)])


def _check(spark, bars, runs, **options):
    loop_options = {"capital": options.get("initial_capital", 10_000.0), "cost": options.get("commission", 0.0005),
                    "stop_fill": options.get("fill_model") == "stop_price", "sizer": options.get("sizer")}
    result = backtest(frame(spark, bars), runs, **options)
    trades = result.trades.toPandas()
    metrics = result.metrics.toPandas().set_index(["run_id", "symbol"])
    for run in runs:
        for symbol, d in bars.groupby("symbol"):
            want = loop(d.reset_index(drop=True), run, **loop_options)
            got = trades[(trades.run_id == run.run_id) & (trades.symbol == symbol) & (trades.status == "closed")]
            got = got.sort_values("entry_pos")
            assert [tuple(t[:3]) for t in want["trades"]] == list(zip(got.entry_pos, got.exit_pos, got.side))
            np.testing.assert_allclose(got[["exit_price", "size", "pnl"]].to_numpy(float).reshape(-1, 3),
                                       np.array([t[4:7] for t in want["trades"]], float).reshape(-1, 3), rtol=1e-9)
            assert list(got.exit_reason) == [t[7] for t in want["trades"]]
            m = metrics.loc[(run.run_id, symbol)]
            for k in ("sharpe", "max_dd_pct", "total_return_pct", "n_trades", "win_rate", "profit_factor",
                      "avg_bars_held", "total_fees", "final_capital"):
                assert m[k] == pytest.approx(want[k], rel=1e-7, abs=1e-8), (run, symbol, k)
    return trades


def test_backtest_equals_loop(spark):
    trades = _check(spark, BARS, RUNS)
    assert {"closed", "open"} <= set(trades.status)


def test_skipped_entries_leave_the_curve(spark):
    """A small account cannot afford most sizes; bars of refused entries are no points of the curve."""
    trades = _check(spark, BARS, RUNS[:2], initial_capital=0.14)
    assert (trades.status == "skipped").sum() > 5


def test_ruined_account(spark):
    trades = _check(spark, BARS, RUNS[:2], initial_capital=0.5, commission=0.05)
    assert (trades.status == "skipped").any()


def test_stop_price_fill_and_other_sizer(spark):
    _check(spark, BARS, RUNS[:2], fill_model="stop_price", sizer=scalar_vol_target_size(0.01, 5.0))


def test_opposite_entry_does_not_close(spark):
    """Under a far stop a trade lives through entries against it."""
    prepared = channel_table(frame(spark, BARS), [RUNS[3]])
    signals = run_signals(prepared, [RUNS[3]])
    trades = select_trades(trade_candidates(signals, prepared)).toPandas()
    against = signals.filter("abs(signal) = 1").toPandas()
    t = trades[trades.symbol == "A"].iloc[0]
    inside = against[(against.symbol == "A") & (against.pos > t.entry_pos) & (against.signal == -t.side)]
    assert len(inside) and (pd.isna(t.exit_pos) or t.exit_pos > inside.pos.min())


def test_dense_curve(spark):
    run = RUNS[0]
    prepared = channel_table(frame(spark, BARS), [run])
    trades = select_trades(trade_candidates(run_signals(prepared, [run]), prepared))
    curve = equity_curve(trades, prepared, [run])
    falls = drawdown(curve).toPandas()
    for symbol, d in BARS.groupby("symbol"):
        want = loop(d.reset_index(drop=True), run)["curve"]
        got = falls[falls.symbol == symbol].sort_values("pos")
        np.testing.assert_allclose(got.equity, want[1:], rtol=1e-9)
        peak = np.maximum.accumulate(want)
        np.testing.assert_allclose(got.drawdown_pct, ((want - peak) / peak * 100)[1:], rtol=1e-7, atol=1e-9)


def test_short_history(spark):
    result = backtest(frame(spark, walk(1, 15)), [RUNS[0]]).metrics.first()
    assert (result["n_trades"], result["sharpe"], result["total_return_pct"], result["profit_factor"]) == (0, 0, 0, 0)


def test_sweep_reports_errors_and_ranks(spark):
    grid = {"entry_period": [0, 10, 20], "exit_period": 5, "atr_period": 10}
    rows = sweep_backtest(frame(spark, walk(50, 400)), grid).collect()
    assert [r["run_id"] for r in rows if r["error"]] == [0]
    ranked = [r["sharpe"] for r in rows if r["error"] is None]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 2
    assert runs_of([{"entry_period": 3}])[0] == [Run(0, 3)]


def test_trades_do_not_depend_on_blocks(spark):
    prepared = channel_table(frame(spark, BARS), RUNS)
    candidates = trade_candidates(run_signals(prepared, RUNS), prepared)
    for cash in (10_000.0, 0.14):
        whole, parts = (select_trades(candidates, cash, block_rows=rows).toPandas().sort_values(["run_id", "symbol", "entry_pos"], ignore_index=True)
                        for rows in (None, 3))
        pd.testing.assert_frame_equal(whole, parts)
        assert len(whole) > 30


def test_successor_is_the_first_candidate_behind_the_exit(spark):
    rows = [("A", 0, 5.0), ("A", 3, 5.0), ("A", 5, 9.0), ("A", 6, None), ("A", 9, 70.0), ("B", 2, 2.0), ("B", 4, None)]
    table = spark.createDataFrame([(1, s, p, None if x is None else int(x)) for s, p, x in rows], "run_id int, symbol string, pos long, exit_pos long")
    got = {(r["symbol"], r["pos"]): (r["index"], r["next"]) for r in successors(table).collect()}
    assert got == {("A", 0): (0, 3), ("A", 3): (1, 3), ("A", 5): (2, 5), ("A", 6): (3, None), ("A", 9): (4, 5), ("B", 2): (0, 1), ("B", 4): (1, None)}
