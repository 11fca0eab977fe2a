"""Forward labels of events: first-touch barriers and fixed horizons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.operators.firsttouch import first_touch
from sparkbars.schema import require_columns

# Narrowest barrier distance and smallest usable volatility.
MIN_BARRIER_GAP = 1e-8
MIN_ATR = 1e-12

Labeler = Callable[[DataFrame, DataFrame], DataFrame]


def last_positions(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("pos").alias("last_pos"))


def event_rows(bars: DataFrame, signal: Column, boolean: bool = False) -> DataFrame:
    """Event rows of an indicator table: every bar whose signal is set, with its ``side``."""
    side = F.when(signal, F.lit(1)) if boolean else F.when(signal != 0, signal.cast("int"))
    return bars.withColumn("side", side).filter(F.col("side").isNotNull())


def _with_exit_close(events: DataFrame, bars: DataFrame) -> DataFrame:
    exits = bars.select("symbol", F.col("pos").alias("exit_idx"), F.col("close").alias("exit_price"))
    return events.join(exits, ["symbol", "exit_idx"], "left")


def _check_barriers(mode: str, upper: float, lower: float) -> None:
    if mode not in ("pct", "atr"):
        raise ValueError(f"barrier mode is 'pct' or 'atr', not {mode!r}")
    if isinstance(upper, str) or isinstance(lower, str):
        return
    if upper <= 0:
        raise ValueError(f"the upper barrier must be positive, got {upper}")
    if mode == "pct" and lower >= 0:
        raise ValueError(f"the lower barrier must be negative, got {lower}")
    if mode == "atr" and lower == 0:
        raise ValueError("the lower barrier must not be zero")


def label_triple_barrier(
    bars: DataFrame,
    events: DataFrame,
    upper_barrier: float | str = 0.02,
    lower_barrier: float | str = -0.01,
    horizon: int | str = 288,
    barrier_mode: str = "pct",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Which barrier an event meets first within ``horizon`` bars; a tie on one bar counts as the loss.

    ``events`` has symbol, pos, side, close (and atr in ATR mode) and any extra ``keys``
    that tell apart events of the same bar. A barrier or horizon given as text names a
    column among the keys, so that one call can serve many settings.
    """
    _check_barriers(barrier_mode, upper_barrier, lower_barrier)
    longest = None if isinstance(horizon, str) else horizon
    upper_barrier, lower_barrier, horizon = (
        F.col(v) if isinstance(v, str) else F.lit(v) for v in (upper_barrier, lower_barrier, horizon)
    )
    atr_mode = barrier_mode == "atr"
    require_columns(events.columns, ["symbol", "pos", "side", "close"] + (["atr"] if atr_mode else []), "events")
    entry, is_long = F.col("entry_price"), F.col("side") == 1
    direction = F.when(is_long, F.lit(1.0)).otherwise(F.lit(-1.0))
    ev = events.select(
        *dict.fromkeys([*keys, "symbol", "pos", "side"]), F.col("close").alias("entry_price"),
        (F.col("atr") if atr_mode else F.lit(None).cast("double")).alias("_atr"),
    )
    if atr_mode:
        atr = F.col("_atr")
        gain = F.when(atr.isNotNull(), F.greatest(upper_barrier * atr, F.lit(0.0)))
        loss = F.when(atr.isNotNull(), F.greatest(F.abs(lower_barrier) * atr, F.lit(0.0)))
        # A barrier never sits closer to the entry than the smallest gap.
        profit = F.when(is_long, F.greatest(entry + gain, entry + MIN_BARRIER_GAP)).otherwise(
            F.least(entry - gain, entry - MIN_BARRIER_GAP))
        stop = F.when(is_long, F.least(entry - loss, entry - MIN_BARRIER_GAP)).otherwise(
            F.greatest(entry + loss, entry + MIN_BARRIER_GAP))
        profit, stop = F.when(atr.isNotNull(), profit), F.when(atr.isNotNull(), stop)
    else:
        profit = F.when(is_long, entry * (upper_barrier + 1.0)).otherwise(entry / (upper_barrier + 1.0))
        stop = F.when(is_long, entry * (lower_barrier + 1.0)).otherwise(entry / (lower_barrier + 1.0))
    ranges = ev.withColumns({
        "_first": F.col("pos") + 1,
        "_last": F.col("pos") + horizon,
        "_hi": F.when(is_long, profit).otherwise(stop),
        "_lo": F.when(is_long, stop).otherwise(profit),
    })
    touched = first_touch(ranges, bars, "_first", "_last", "_hi", "_lo", longest)
    win = F.when(is_long, F.col("touch_up")).otherwise(F.col("touch_down"))
    lose = F.when(is_long, F.col("touch_down")).otherwise(F.col("touch_up"))
    hit = touched.withColumns({
        "label": F.when(lose, F.lit(-1)).when(win, F.lit(1)).otherwise(F.lit(0)),
        "_exit": F.coalesce("touch_pos", F.col("pos") + horizon),
    }).join(last_positions(bars), "symbol")
    capped = hit.withColumns({
        "exit_idx": F.least("_exit", "last_pos"),
        "truncated": F.col("_exit") > F.col("last_pos"),
        "barrier_hit": F.when(F.col("label") == 1, F.lit("upper"))
        .when(F.col("label") == -1, F.lit("lower")).otherwise(F.lit("timeout")),
    }).withColumn("n_bars_held", F.col("exit_idx") - F.col("pos"))
    priced = _with_exit_close(capped, bars)
    gain_price = (F.col("exit_price") - entry) * direction
    safe_atr = F.when(F.col("_atr") > MIN_ATR, F.col("_atr")).otherwise(F.lit(1.0))
    log_return = F.ln(F.col("exit_price") / entry)
    return priced.select(
        *keys, "symbol", "pos", "label", "barrier_hit", "exit_idx", "n_bars_held", "entry_price", "exit_price",
        F.when(is_long, log_return).otherwise(-log_return).alias("actual_return"),
        (gain_price / safe_atr if atr_mode else F.lit(None).cast("double")).alias("return_atr"),
        "truncated",
    )


def label_fixed_horizon(bars: DataFrame, events: DataFrame, horizon: int = 14400) -> DataFrame:
    """Simple return ``horizon`` bars ahead (or at the last bar) over the daily ATR share."""
    require_columns(events.columns, ["symbol", "pos", "side", "close", "atr_daily"], "events")
    ev = events.select(
        "symbol", "pos", "side", F.col("close").alias("entry_price"), "atr_daily"
    ).join(last_positions(bars), "symbol")
    ev = ev.withColumn("exit_idx", F.least(F.col("pos") + horizon, F.col("last_pos")))
    priced = _with_exit_close(ev, bars)
    change = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    safe = F.when(F.col("atr_daily") > MIN_ATR, F.col("atr_daily")).otherwise(F.lit(1.0))
    return priced.withColumn(
        "raw_return", F.when(F.col("side") == 1, change).otherwise(-change)
    ).select(
        "symbol", "pos", (F.col("raw_return") / safe).alias("y_norm"), "raw_return", "entry_price",
        "exit_price", "exit_idx", (F.col("pos") + horizon > F.col("last_pos")).alias("truncated"),
    )


def common_labels(fixed: DataFrame) -> DataFrame:
    """Fixed-horizon labels in the columns every labeler shares, y_norm and raw_return kept."""
    return fixed.select(
        "symbol", "pos",
        F.signum("y_norm").cast("int").alias("label"),
        F.lit("fixed_horizon").alias("barrier_hit"),
        "exit_idx",
        (F.col("exit_idx") - F.col("pos")).alias("n_bars_held"),
        "entry_price", "exit_price",
        F.col("raw_return").alias("actual_return"),
        F.col("y_norm").alias("return_atr"),
        "truncated", "y_norm", "raw_return",
    )


def triple_barrier_labeler(**params) -> Labeler:
    return lambda bars, events: label_triple_barrier(bars, events, **params)


def fixed_horizon_labeler(horizon: int = 14400) -> Labeler:
    return lambda bars, events: common_labels(label_fixed_horizon(bars, events, horizon))
