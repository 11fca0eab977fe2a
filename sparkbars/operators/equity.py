"""Equity curves of trades and the metrics of a run.

Equity moves only while a position is open. Metrics therefore look at the bars inside
trades, one row per trade and block of bars, and account for the flat bars by counting
them; the dense curve exists for those who want every bar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.operators.labels import last_positions
from sparkbars.operators.running import Running, running
from sparkbars.operators.trades import Run

BLOCK_ROWS = 1024
HISTORY_CHUNK = 65_536
PERIODS_PER_YEAR = 365 * 24 * 60  # one-minute bars


def run_table(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """One row per (run_id, symbol) with its warm-up and last position."""
    grid = F.array(*[F.struct(F.lit(r.run_id).alias("run_id"), F.lit(r.warmup).cast("long").alias("warmup")) for r in runs])
    return last_positions(bars).select("symbol", "last_pos", F.explode(grid).alias("r")).select(
        "r.run_id", "symbol", "r.warmup", "last_pos"
    )


def _unrealized(side: Column, close: Column, entry: Column, size: Column) -> Column:
    return side * (close - entry) * size


_STATS = ("highest", "lowest", "worst", "last_equity", "ret_sum", "ret_sq")
_PIECE = ["run_id", "symbol", "exit_pos", "pos"]


def _piece_stats(prices: np.ndarray, capital: float, units: float, entry: float, exit_equity: float, skip: int) -> tuple:
    """Equity of one trade over some bars: extremes, worst fall inside, last value, returns; ``prices`` begin one bar earlier."""
    equity = capital + units * (prices - entry)
    earlier = equity[:-1].copy()
    equity = equity[1:]
    if not np.isnan(exit_equity):
        equity[-1] = exit_equity
    peak = np.maximum.accumulate(equity)
    counted = slice(max(skip, 0), None)
    rise = equity[counted] / earlier[counted] - 1.0
    return equity.max(), equity.min(), ((equity - peak) / peak).min(), equity[-1], rise.sum(), (rise * rise).sum()


def _block_stats(key, pieces: pa.Table, closes: pa.Table) -> pa.Table:
    """Statistics of all trades that hold over one block of bars."""
    closes = closes.sort_by("pos")
    values = closes["close"].to_numpy()
    before = closes["prev_close"][0].as_py() if len(closes) else None
    known = np.concatenate(([np.nan if before is None else before], values))
    columns = [pieces[c].to_numpy() for c in ("_lo", "_hi", "capital_before", "_units", "entry_price", "_exit_equity", "_skip")]
    rows = [_piece_stats(known[lo : hi + 2], *rest[:-1], int(rest[-1])) for lo, hi, *rest in zip(*columns)]
    stats = np.array(rows, np.float64).reshape(-1, len(_STATS))
    return pa.table([*[pieces[c] for c in _PIECE], *map(pa.array, stats.T)], [*_PIECE, *_STATS])


def trade_blocks(trades: DataFrame, bars: DataFrame, runs: Sequence[Run], block: int = BLOCK_ROWS) -> DataFrame:
    """Equity statistics of every trade per block of bars, instead of one row per bar and run.

    Covers the bars after an entry up to its exit (or the end of data). The closes of a block, ``block`` values at
    most, meet the trades of all runs that hold over it and travel once.
    """
    held = trades.filter("status <> 'skipped'").join(last_positions(bars), "symbol").select(
        "run_id", "symbol", "side", "entry_price", "size", "capital_before", "capital_after", "skipped_before",
        "exit_pos", (F.col("entry_pos") + 1).alias("_from"), F.coalesce("exit_pos", "last_pos").alias("_to"),
    ).filter("_from <= _to")
    spread = held.withColumn("_blk", F.explode(F.expr(f"sequence(_from div {block}, _to div {block})")))
    start = F.greatest(F.col("_from"), F.col("_blk") * block)
    end = F.least(F.col("_to"), (F.col("_blk") + 1) * block - 1)
    # Point 0 of the curve is the initial capital; returns count from point warm-up + 1 on.
    first_counted = 2 * _warmup_of(runs) + F.col("skipped_before")
    pieces = spread.select(
        "run_id", "symbol", "exit_pos", start.alias("pos"), "_blk", "capital_before", "entry_price",
        (start - F.col("_blk") * block).alias("_lo"), (end - F.col("_blk") * block).alias("_hi"),
        (F.col("side") * F.col("size")).alias("_units"),
        F.when(end == F.col("exit_pos"), F.col("capital_after")).otherwise(F.lit(float("nan"))).alias("_exit_equity"),
        (first_counted - start).alias("_skip"),
    )
    # Positions are dense, so a block's closes in order are at their offsets.
    closes = bars.select(F.col("symbol").alias("symbol"), F.expr(f"pos div {block}").alias("_blk"), "pos", "close", "prev_close")
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in _PIECE], *[f"{c} double" for c in _STATS]])
    return pieces.groupBy("symbol", "_blk").cogroup(closes.groupBy("symbol", "_blk")).applyInArrow(_block_stats, schema)


def equity_curve(
    trades: DataFrame, bars: DataFrame, runs: Sequence[Run], initial_capital: float = 10_000.0
) -> DataFrame:
    """Equity of every bar from warm-up on, one row per (run_id, symbol, pos).

    ``skipped`` marks a bar whose entry was refused for lack of size.
    """
    grid = F.array(*[F.struct(F.lit(r.run_id).alias("run_id"), F.lit(r.warmup).alias("warmup")) for r in runs])
    dense = bars.select("symbol", "pos", "close", F.explode(grid).alias("r")).select(
        F.col("r.run_id").alias("run_id"), "symbol", "pos", "close"
    ).filter(F.col("pos") >= _warmup_of(runs))
    kept = trades.filter("status <> 'skipped'")
    marks = (
        kept.select(
            "run_id", "symbol", F.col("entry_pos").alias("pos"),
            F.struct(
                F.col("side").cast("double").alias("side"), F.col("entry_price").alias("entry"), "size",
                F.col("capital_before").alias("capital"),
            ).alias("mark"),
        )
        .unionByName(
            kept.filter("status = 'closed'").select(
                "run_id", "symbol", F.col("exit_pos").alias("pos"),
                F.struct(
                    F.lit(0.0).alias("side"), F.lit(0.0).alias("entry"), F.lit(0.0).alias("size"),
                    F.col("capital_after").alias("capital"),
                ).alias("mark"),
            )
        )
        .withColumn("skipped", F.lit(False))
        .unionByName(
            trades.filter("status = 'skipped'").select(
                "run_id", "symbol", F.col("entry_pos").alias("pos"), F.lit(True).alias("skipped")
            ),
            allowMissingColumns=True,
        )
    )
    joined = dense.join(marks, ["run_id", "symbol", "pos"], "left").withColumn(
        "_chunk", F.floor(F.col("pos") / HISTORY_CHUNK)
    )
    state = running(joined, ["run_id", "symbol"], "_chunk", "pos", [Running("state", "last", F.col("mark"))])
    open_value = _unrealized(F.col("state.side"), F.col("close"), F.col("state.entry"), F.col("state.size"))
    return state.select(
        "run_id", "symbol", "pos",
        F.coalesce(F.col("state.capital") + open_value, _account(runs, "cash", initial_capital)).alias("equity"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
    )


def _warmup_of(runs: Sequence[Run]) -> Column:
    warmups = F.create_map(*[x for r in runs for x in (F.lit(r.run_id), F.lit(r.warmup))])
    return F.element_at(warmups, F.col("run_id"))


def _account(runs: Sequence[Run], name: str, general: float) -> Column:
    """An account value of the row's run."""
    own = [x for r in runs if getattr(r, name) is not None for x in (F.lit(r.run_id), F.lit(float(getattr(r, name))))]
    if not own:
        return F.lit(float(general))
    return F.coalesce(F.try_element_at(F.create_map(*own), F.col("run_id")), F.lit(float(general)))


def drawdown(curve: DataFrame, initial_capital: float = 10_000.0) -> DataFrame:
    """Running peak (from the initial capital) and drawdown in percent, as a negative number, per bar."""
    chunked = curve.withColumn("_chunk", F.floor(F.col("pos") / HISTORY_CHUNK))
    peaks = running(chunked, ["run_id", "symbol"], "_chunk", "pos", [Running("_peak", "max", F.col("equity"))])
    peak = F.greatest(F.col("_peak"), F.lit(float(initial_capital)))
    return peaks.select(
        "run_id", "symbol", "pos", "equity", peak.alias("peak"),
        F.try_divide((F.col("equity") - peak) * 100, peak).alias("drawdown_pct"),
    )


def run_metrics(
    trades: DataFrame,
    bars: DataFrame,
    runs: Sequence[Run],
    initial_capital: float = 10_000.0,
    commission: float = 0.0005,
    periods_per_year: float = PERIODS_PER_YEAR,
) -> DataFrame:
    """One row of raw metrics per (run_id, symbol); ``display_metrics`` rounds them.

    The curve starts with the initial capital, then holds one point per bar from warm-up
    on, without bars whose entry was refused. Sharpe leaves out the first ``warmup`` points.
    """
    ids = ["run_id", "symbol"]
    cash, rate = _account(runs, "cash", initial_capital), _account(runs, "commission", commission)
    chunked = trade_blocks(trades, bars, runs).withColumn("_chunk", F.expr(f"pos div {HISTORY_CHUNK}"))
    peaked = running(
        chunked, ids, "_chunk", "pos", [Running("_peak", "max", F.col("highest"))], exclusive=True
    )
    # The worst fall of a block starts inside it or at the highest point before it.
    peak = F.greatest(F.col("_peak"), cash)
    fall = F.least(F.col("worst"), F.try_divide(F.col("lowest") - peak, peak))
    moved = peaked.groupBy(*ids).agg(
        F.sum("ret_sum").alias("_s1"),
        F.sum("ret_sq").alias("_s2"),
        (F.min(fall) * 100).alias("_worst"),
        F.max_by("last_equity", F.when(F.col("exit_pos").isNull(), F.col("pos"))).alias("_open_equity"),
    )
    closed, pnl = F.col("status") == "closed", F.col("pnl")
    won, lost = closed & (pnl > 0), closed & (pnl < 0)
    fees = rate * (F.col("entry_price") + F.col("exit_price")) * F.col("size")
    traded = trades.groupBy(*ids).agg(
        F.max_by("capital_after", "entry_pos").alias("_capital"),
        F.count_if(F.col("status") == "skipped").alias("_skipped"),
        F.count_if(closed).alias("_n"),
        F.count_if(won).alias("_wins"),
        F.count_if(lost).alias("_losses"),
        F.sum(F.when(won, pnl)).alias("_won"),
        F.sum(F.when(lost, pnl)).alias("_lost"),
        F.avg(F.when(closed, pnl)).alias("_avg"),
        F.avg(F.when(closed, F.col("exit_pos") - F.col("entry_pos"))).alias("_held"),
        F.sum(F.when(closed, fees)).alias("_fees"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    zero_d = lambda c: F.coalesce(c, F.lit(0.0))
    points = F.greatest(F.col("last_pos") - F.col("warmup") + 1, F.lit(0)) + 1 - zero("_skipped")
    n_ret = points - 1 - F.col("warmup")
    # Short histories have no counted return; shared parts are evaluated before their guard.
    mean = F.try_divide(zero("_s1"), n_ret)
    variance = F.try_divide(zero("_s2") - n_ret * mean * mean, n_ret - 1)
    sharpe = F.when(
        (n_ret > 1) & (zero("_s2") > 0) & (variance > 0),
        F.try_divide(mean, F.sqrt(variance)) * F.sqrt(F.lit(float(periods_per_year))),
    )
    final = F.coalesce(F.col("_capital"), cash)
    profit_factor = (
        F.when(zero("_n") == 0, F.lit(0.0))
        .when(F.abs("_lost") > 0, F.try_divide(zero("_won"), F.abs("_lost")))
        .otherwise(F.lit(float("inf")))
    )
    joined = run_table(bars, runs).join(moved, ids, "left").join(traded, ids, "left")
    return joined.select(
        *ids,
        zero_d(sharpe).alias("sharpe"),
        zero_d(F.try_divide("_wins", "_n")).alias("win_rate"),
        ((F.try_divide(F.coalesce(F.col("_open_equity"), final), cash) - 1) * 100).alias("total_return_pct"),
        F.abs(F.least(zero_d(F.col("_worst")), F.lit(0.0))).alias("max_dd_pct"),
        zero("_n").cast("long").alias("n_trades"),
        zero("_wins").cast("long").alias("n_wins"),
        zero("_losses").cast("long").alias("n_losses"),
        profit_factor.alias("profit_factor"),
        zero_d(F.col("_avg")).alias("avg_trade_pnl"),
        zero_d(F.try_divide("_won", "_wins")).alias("avg_win"),
        zero_d(F.try_divide("_lost", "_losses")).alias("avg_loss"),
        zero_d(F.col("_held")).alias("avg_bars_held"),
        zero_d(F.col("_fees")).alias("total_fees"),
        final.alias("final_capital"),
    )


# Digits shown per metric.
DISPLAY_DIGITS = {
    "sharpe": 4, "win_rate": 4, "total_return_pct": 2, "max_dd_pct": 2, "profit_factor": 2,
    "avg_trade_pnl": 2, "avg_win": 2, "avg_loss": 2, "avg_bars_held": 1, "total_fees": 2,
}


def display_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics rounded for reports; infinite values stay as they are."""
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    return metrics.withColumns({
        c: F.when(finite(c), F.round(c, d)).otherwise(F.col(c))
        for c, d in DISPLAY_DIGITS.items() if c in metrics.columns
    })
