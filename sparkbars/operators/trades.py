"""Trades of a breakout rule: candidates with their exits, then one position at a time.

Exits of all candidates are found in parallel, and so are the trades: each candidate has one successor,
the first entry after its exit, and the trades are the path through these. Only the compounding capital is read in
order, over the trades that are made. An account that cannot afford an entry lets it pass, which changes
the path; such a run is read candidate by candidate from there on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.signals import EXIT_LONG, EXIT_SHORT, five_way, stop_level, warmup_bars
from sparkbars.functions.sizing import ScalarSizer, scalar_risk_size
from sparkbars.operators.firsttouch import first_touch
from sparkbars.operators.fold import ordered_fold
from sparkbars.operators.labels import last_positions
from sparkbars.operators.running import Running, running
from sparkbars.operators.walk import path
from sparkbars.session import cut

SIGNAL_CHUNK = 65_536


@dataclass(frozen=True)
class Run:
    """One parameter set of the breakout rule, and of the account that trades it.

    Account values left open are those of the backtest.
    """

    run_id: int
    entry_period: int = 20
    exit_period: int = 10
    atr_period: int = 20
    atr_mult: float = 2.0
    intensity_threshold: float = 0.0
    cash: float | None = None
    commission: float | None = None
    risk_pct: float | None = None
    max_leverage: float | None = None

    @property
    def warmup(self) -> int:
        return warmup_bars(self.entry_period, self.atr_period)


def run_signals(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Signals that are not 0 of every run, one row per (run_id, symbol, pos), from warm-up on.

    ``bars`` comes from ``add_channels`` over the periods of all runs. Parameter sets
    are evaluated inside the row, so bars are neither joined with nor copied per run.
    """
    entries = sorted({r.entry_period for r in runs})
    exits = sorted({r.exit_period for r in runs})
    atrs = sorted({r.atr_period for r in runs})
    doubles = {"mult": "atr_mult", "threshold": "intensity_threshold"}
    grid = F.array(*[
        F.struct(
            F.lit(r.run_id).cast("int").alias("run_id"),
            F.lit(entries.index(r.entry_period)).alias("e"),
            F.lit(exits.index(r.exit_period)).alias("x"),
            F.lit(atrs.index(r.atr_period)).alias("a"),
            F.lit(r.warmup).alias("warmup"),
            *[F.lit(float(getattr(r, f))).alias(n) for n, f in doubles.items()],
        )
        for r in runs
    ])
    close = F.col("close")

    def level(prefix: str, periods: Sequence[int], index: Column) -> Column:
        return F.get(F.array(*[F.col(f"{prefix}_{p}") for p in periods]), index)

    def evaluate(p: Column) -> Column:
        atr = level("atr", atrs, p["a"])
        signal = five_way(
            close, level("high", entries, p["e"]), level("low", entries, p["e"]),
            level("high", exits, p["x"]), level("low", exits, p["x"]), atr, p["threshold"],
        )
        return F.struct(
            p["run_id"].alias("run_id"),
            F.when(F.col("pos") >= p["warmup"], signal).otherwise(F.lit(0)).alias("signal"),
            stop_level(signal, close, atr, p["mult"]).alias("stop_price"),
            atr.alias("atr"),
            p["mult"].alias("atr_mult"),
        )

    signals = F.filter(F.transform(grid, evaluate), lambda s: s["signal"] != 0)
    # Few bars leave any channel; a plain comparison finds them before parameter sets are looked at.
    channels = sorted(set(entries) | set(exits))
    outside = F.lit(False)
    for p in channels:
        outside = outside | F.coalesce((close > F.col(f"high_{p}")) | (close < F.col(f"low_{p}")), F.lit(False))
    moved = bars.filter(outside & (F.col("pos") >= min(r.warmup for r in runs)))
    return moved.select("symbol", "pos", "close", F.explode(signals).alias("s")).select(
        F.col("s.run_id").alias("run_id"), "symbol", "pos", F.col("s.signal").alias("signal"),
        "close", F.col("s.stop_price").alias("stop_price"), F.col("s.atr").alias("atr"),
        F.col("s.atr_mult").alias("atr_mult"),
    )


def trade_candidates(
    signals: DataFrame, bars: DataFrame, fill_model: str = "worse_of"
) -> DataFrame:
    """Every entry signal with the exit it would have: stop touch or exit signal, whichever comes first.

    A stop beats a signal on the same bar. ``fill_model`` prices a stop exit at the worse
    of close and stop (``worse_of``) or at the stop itself (``stop_price``). ``exit_pos``
    is NULL where the data ends first.
    """
    if fill_model not in ("worse_of", "stop_price"):
        raise ValueError(f"unknown fill model {fill_model!r}")
    chunked = signals.withColumn("_chunk", F.floor(F.col("pos") / SIGNAL_CHUNK))
    ahead = running(
        chunked, ["run_id", "symbol"], "_chunk", "pos",
        [
            Running("_exit_long", "min", F.when(F.col("signal") == EXIT_LONG, F.col("pos"))),
            Running("_exit_short", "min", F.when(F.col("signal") == EXIT_SHORT, F.col("pos"))),
        ],
        reverse=True,
    )
    side = F.col("signal")
    entries = ahead.filter(F.abs("signal") == 1).select(
        "run_id", "symbol", "pos", side.alias("side"), F.col("close").alias("entry_price"), "stop_price",
        "atr", "atr_mult",
        F.when(side == 1, F.col("_exit_long")).otherwise(F.col("_exit_short")).alias("signal_exit"),
    ).join(last_positions(bars), "symbol")
    ranges = entries.withColumns({
        "_first": F.col("pos") + 1,
        "_last": F.coalesce("signal_exit", "last_pos"),
        "_hi": F.when(F.col("side") == -1, F.col("stop_price")),
        "_lo": F.when(F.col("side") == 1, F.col("stop_price")),
    })
    touched = first_touch(ranges, bars, "_first", "_last", "_hi", "_lo")
    stop_at = F.col("touch_pos")
    resolved = touched.withColumns({
        "exit_pos": F.coalesce(stop_at, "signal_exit"),
        "exit_reason": F.when(stop_at.isNotNull(), "stop").when(F.col("signal_exit").isNotNull(), "signal"),
    })
    closes = bars.select("symbol", F.col("pos").alias("exit_pos"), F.col("close").alias("_exit_close"))
    stop, close = F.col("stop_price"), F.col("_exit_close")
    worse = F.when(F.col("side") == 1, F.least(close, stop)).otherwise(F.greatest(close, stop))
    at_stop = worse if fill_model == "worse_of" else stop
    return resolved.join(closes, ["symbol", "exit_pos"], "left").select(
        "run_id", "symbol", "pos", "side", "entry_price", "stop_price", "atr", "atr_mult", "exit_pos",
        F.when(F.col("exit_reason") == "stop", at_stop).otherwise(close).alias("exit_price"),
        "exit_reason",
    )


_TRADE_SCHEMA = (
    "run_id int, symbol string, entry_pos long, side int, entry_price double, stop_price double, "
    "exit_pos long, exit_price double, exit_reason string, size double, pnl double, "
    "capital_before double, capital_after double, skipped_before long, status string"
)
_KEYS = ["run_id", "symbol"]


def successors(candidates: DataFrame) -> DataFrame:
    """Adds ``index``, the number of a candidate in its run and symbol, and ``next``, that of the first one after its exit.

    Candidates and exits are counted along the bars in one pass; at one bar the candidate comes first, as an exit bar is no
    entry. ``next`` is NULL without an exit.
    """
    row = F.struct(*[F.col(c) for c in candidates.columns if c not in _KEYS])
    # even places are candidates, odd ones the exits behind them
    both = candidates.select(*_KEYS, F.explode(F.array(
        F.struct((F.col("pos") * 2).alias("at"), F.lit(1).alias("n"), row.alias("row")),
        F.struct((F.col("exit_pos") * 2 + 1).alias("at"), F.lit(0).alias("n"), row.alias("row")),
    )).alias("e")).select(*_KEYS, "e.*").filter("at IS NOT NULL")
    chunked = both.withColumn("_chunk", F.expr(f"at div {2 * SIGNAL_CHUNK}"))
    # candidates of one exit bar share its place, but only entries count
    counted = running(chunked, _KEYS, "_chunk", "at", [Running("seen", "sum", F.col("n"))])
    entry = F.col("n") == 1
    found = counted.groupBy(*_KEYS, F.col("row.pos").alias("pos")).agg(
        F.max(F.when(entry, F.col("seen") - 1)).cast("long").alias("index"),
        F.max(F.when(~entry, F.col("seen"))).cast("long").alias("next"),
        F.first(F.when(entry, F.col("row")), ignorenulls=True).alias("row"),
    )
    return found.select(*_KEYS, "row.*", "index", "next")


def select_trades(
    candidates: DataFrame,
    initial_capital: float = 10_000.0,
    commission: float = 0.0005,
    sizer: ScalarSizer | None = None,
    runs: Sequence[Run] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Candidates actually tried: one position at a time, capital compounding trade by trade.

    Account values of a run in ``runs`` go before the general ones; a run that names a
    risk or a leverage is sized by them.

    The next entry comes strictly after the exit bar and an unfinished trade blocks the
    rest. ``status`` is closed, open, or skipped for an entry whose size was zero.
    """
    general = sizer or scalar_risk_size()
    accounts = {
        r.run_id: (
            initial_capital if r.cash is None else r.cash,
            commission if r.commission is None else r.commission,
            general if r.risk_pct is None and r.max_leverage is None else scalar_risk_size(
                **{k: v for k, v in (("risk_pct", r.risk_pct), ("max_leverage", r.max_leverage)) if v is not None}
            ),
        )
        for r in runs
    }
    names = [f.split()[0] for f in _TRADE_SCHEMA.split(", ")]

    def account(rows: pd.DataFrame):
        return accounts.get(int(rows["run_id"].iat[0]), (initial_capital, commission, general))

    def tried(rows: pd.DataFrame, i: int, size_of: ScalarSizer, rate: float, capital: float) -> tuple:
        """(size, pnl, status) of one candidate."""
        cell = lambda c: float(rows[c].iat[i])
        stop, atr = (None if np.isnan(v) else v for v in (cell("stop_price"), cell("atr")))
        size = size_of(capital, cell("entry_price"), stop, atr, cell("atr_mult"))
        if size <= 0:
            return 0.0, None, "skipped"
        if pd.isna(rows["exit_pos"].iat[i]):
            return size, None, "open"
        fees = rate * (cell("entry_price") + cell("exit_price")) * size
        return size, int(rows["side"].iat[i]) * (cell("exit_price") - cell("entry_price")) * size - fees, "closed"

    def shown(rows: pd.DataFrame, taken: list[tuple]) -> pd.DataFrame:
        out = rows.iloc[[t[0] for t in taken]].rename(columns={"pos": "entry_pos"})
        extra = ["size", "pnl", "capital_before", "capital_after", "skipped_before", "status"]
        out = out.assign(**{c: [t[j + 1] for t in taken] for j, c in enumerate(extra)})
        out["exit_pos"] = out["exit_pos"].astype("Int64")
        out["pnl"] = out["pnl"].astype("float64")
        return out

    def on_path(rows: pd.DataFrame, state):
        """Trades of the path; the first refused one ends it. State: capital, or None once that happened."""
        cash, rate, size_of = account(rows)
        (capital,) = state or (cash,)
        taken = []
        for i in range(len(rows)):
            if capital is None:
                break
            size, pnl, status = tried(rows, i, size_of, rate, capital)
            taken.append((i, size, pnl, capital, capital + (pnl or 0.0), 0, status))
            capital = None if status == "skipped" else capital + (pnl or 0.0)
        return shown(rows, taken)[[*names, "index"]], (capital,)

    def one_by_one(rows: pd.DataFrame, state):
        """Every candidate from the first refused one on. State: index that is free again, capital, entries skipped."""
        _, rate, size_of = account(rows)
        free, capital, skipped = state or (int(rows["index"].iat[0]), float(rows["_capital"].iat[0]), 0)
        index, after = rows["index"].to_numpy(), rows["next"].to_numpy(dtype="float64")
        taken, i = [], int(np.searchsorted(index, free))
        while i < len(rows):
            size, pnl, status = tried(rows, i, size_of, rate, capital)
            taken.append((i, size, pnl, capital, capital + (pnl or 0.0), skipped, status))
            skipped += status == "skipped"
            capital += pnl or 0.0
            free = int(index[i]) + 1 if status == "skipped" else np.iinfo(np.int64).max if status == "open" else int(after[i])
            i = int(np.searchsorted(index, free))
        return shown(rows, taken)[names], (free, capital, skipped)

    nodes = cut(successors(candidates))
    made = path(nodes.select(*_KEYS, "index", "next"), _KEYS, block_rows)
    chosen = nodes.join(made, [*_KEYS, "index"])
    first = cut(ordered_fold(chosen, _KEYS, ["index"], on_path, f"{_TRADE_SCHEMA}, index long"))
    refused = first.filter("status = 'skipped'").select(*_KEYS, F.col("index").alias("_from"), F.col("capital_before").alias("_capital"))
    trades = first.filter("status <> 'skipped'").drop("index")
    if refused.isEmpty():
        return trades
    again = nodes.join(refused, _KEYS).filter("index >= _from").drop("_from")
    return trades.unionByName(ordered_fold(again, _KEYS, ["index"], one_by_one, _TRADE_SCHEMA))


def trade_log(trades: DataFrame, bars: DataFrame, initial_capital: float = 10_000.0) -> DataFrame:
    """Closed trades in report columns; ``pnl_pct`` refers to the initial capital."""
    times = bars.select("symbol", "pos", "open_time")
    closed = trades.filter("status = 'closed'")
    entry = times.select("symbol", F.col("pos").alias("entry_pos"), F.col("open_time").alias("entry_time"))
    leave = times.select("symbol", F.col("pos").alias("exit_pos"), F.col("open_time").alias("exit_time"))
    return closed.join(entry, ["symbol", "entry_pos"]).join(leave, ["symbol", "exit_pos"]).select(
        "run_id", "symbol", "entry_time", "exit_time",
        F.when(F.col("side") == 1, "long").otherwise("short").alias("side"),
        "entry_price", "exit_price", "stop_price", "size", "pnl",
        (F.col("pnl") / initial_capital * 100).alias("pnl_pct"),
        (F.col("exit_pos") - F.col("entry_pos")).alias("bars_held"), "exit_reason",
    )
