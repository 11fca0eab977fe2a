"""Rolling indicators of a bar table: channels, range, volume, trend and flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.operators.rolling import HaloFrame, Roll, halo_frame

RETURN_LAGS = (5, 10, 30)
DAILY_BARS = 1440  # one day of one-minute bars


def _true_range(frame: HaloFrame) -> HaloFrame:
    frame.with_columns({"_prev_close": frame.lagged("close", 1)})
    high, low, prev = F.col("high"), F.col("low"), F.col("_prev_close")
    return frame.with_columns({"tr": F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))})


def add_indicators(
    bars: DataFrame,
    entry_period: int = 20,
    exit_period: int = 10,
    atr_period: int = 20,
    vol_period: int = 20,
    ma_period: int = 200,
    daily_bars: int = DAILY_BARS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add every indicator column; row ``i`` of a shifted one reads only bars before ``i``.

    ``bars`` needs symbol, pos, high, low, close and volume; ``taker_buy_base`` is
    optional and brings ``taker_buy_ratio``.
    """
    lookback = max(entry_period, exit_period, vol_period, ma_period, *RETURN_LAGS, 1 + atr_period + daily_bars) + 1
    frame = _true_range(halo_frame(bars, lookback, chunk_rows))
    has_taker = "taker_buy_base" in bars.columns
    frame.with_columns({"_log_volume": F.when(F.col("volume") > 0, F.ln("volume"))})
    rolls = [
        Roll("entry_high", "max", "high", entry_period),
        Roll("entry_low", "min", "low", entry_period),
        Roll("exit_high", "max", "high", exit_period),
        Roll("exit_low", "min", "low", exit_period),
        Roll("atr", "avg", "tr", atr_period),
        Roll("vol_ma", "avg", "volume", vol_period),
        Roll("_log_mean", "avg", "_log_volume", vol_period),
        Roll("_log_std", "std", "_log_volume", vol_period),
        Roll("ma", "avg", "close", ma_period),
    ]
    if has_taker:
        rolls += [
            Roll("_taker_sum", "sum", "taker_buy_base", vol_period),
            Roll("_volume_sum", "sum", "volume", vol_period),
        ]
    ratios = {"_atr_share": ("atr", "close")}
    rolls.append(Roll("atr_daily", "avg", "_atr_share", daily_bars, current=True))
    frame.with_columns({f"_close_{k}": frame.lagged("close", k) for k in RETURN_LAGS}).roll(rolls, ratios=ratios)
    close, width = F.col("close"), F.col("entry_high") - F.col("entry_low")
    columns = {
        "vol_ratio": F.try_divide("volume", "vol_ma"),
        "vol_zscore": F.try_divide(F.col("_log_volume") - F.col("_log_mean"), F.col("_log_std")),
        "channel_pos": F.when(
            width > 0,
            F.least(F.greatest(F.try_divide(close - F.col("entry_low"), width), F.lit(0.0)), F.lit(1.0)),
        ).otherwise(F.lit(0.5)),
    }
    for k in RETURN_LAGS:
        columns[f"ret_{k}"] = F.try_divide(close, F.col(f"_close_{k}")) - 1.0
    if has_taker:
        columns["taker_buy_ratio"] = F.try_divide("_taker_sum", "_volume_sum")
    frame.with_columns(columns)
    hidden = ["_prev_close", "_log_volume", "_log_mean", "_log_std", "_taker_sum", "_volume_sum", "_atr_share"]
    hidden += [f"_close_{k}" for k in RETURN_LAGS]
    return frame.core().drop(*hidden)


def add_channels(
    bars: DataFrame,
    entry_periods: Sequence[int],
    exit_periods: Sequence[int],
    atr_periods: Sequence[int],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Channels and average range for several periods at once, one column set per distinct period.

    A sweep asks for many parameter sets that share few periods; each period is
    computed once and all of them share one shuffle of the bars. ``prev_close`` is kept
    for marking open trades.
    """
    entries, exits, atrs = sorted(set(entry_periods)), sorted(set(exit_periods)), sorted(set(atr_periods))
    channels = sorted(set(entries) | set(exits))
    lookback = max(*channels, 1 + max(atrs)) + 1
    frame = _true_range(halo_frame(bars, lookback, chunk_rows))
    frame.roll(
        [Roll(f"high_{p}", "max", "high", p) for p in channels]
        + [Roll(f"low_{p}", "min", "low", p) for p in channels]
        + [Roll(f"atr_{p}", "avg", "tr", p) for p in atrs]
    )
    return frame.core().withColumnRenamed("_prev_close", "prev_close").drop("tr")
