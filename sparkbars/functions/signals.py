"""Breakout, exit and stop columns over the indicator columns of a bar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal codes.
LONG, SHORT, EXIT_LONG, EXIT_SHORT, HOLD = 1, -1, 2, -2, 0


def valid_atr(atr: Column) -> Column:
    """ATR usable as a divisor: 1 where it is missing or not positive."""
    return F.when(atr > 0, atr).otherwise(F.lit(1.0))


def intensities(close: Column, entry_high: Column, entry_low: Column, atr: Column) -> tuple[Column, Column]:
    unit = valid_atr(atr)
    return (close - entry_high) / unit, (entry_low - close) / unit


def breakout_event(
    threshold: float | Column = 0.0,
    signed: bool = True,
    close: str = "close",
    entry_high: str = "entry_high",
    entry_low: str = "entry_low",
    atr: str = "atr",
) -> Column:
    """1 or -1 where the close leaves the channel by more than ``threshold`` ATR, else 0.

    On a bar that qualifies on both sides the short side stands. Unsigned form: boolean.
    """
    c, hi, lo = F.col(close), F.col(entry_high), F.col(entry_low)
    up, down = intensities(c, hi, lo, F.col(atr))
    long_event = (c > hi) & (up > threshold)
    short_event = (c < lo) & (down > threshold)
    if not signed:
        return F.coalesce(long_event, F.lit(False)) | F.coalesce(short_event, F.lit(False))
    return F.when(short_event, F.lit(SHORT)).when(long_event, F.lit(LONG)).otherwise(F.lit(HOLD))


def five_way(
    close: Column,
    entry_high: Column,
    entry_low: Column,
    exit_high: Column,
    exit_low: Column,
    atr: Column,
    threshold: Column | float,
) -> Column:
    """Signal of one bar for a whole table: entries first, exits only on bars without an entry.

    An entry against an open position is therefore no exit for it.
    """
    up, down = intensities(close, entry_high, entry_low, atr)
    short_entry = (close < entry_low) & (down > threshold)
    long_entry = (close > entry_high) & (up > threshold)
    return (
        F.when(short_entry, F.lit(SHORT))
        .when(long_entry, F.lit(LONG))
        .when(close > exit_high, F.lit(EXIT_SHORT))
        .when(close < exit_low, F.lit(EXIT_LONG))
        .otherwise(F.lit(HOLD))
    )


def last_bar_signal(
    close: Column,
    entry_high: Column,
    entry_low: Column,
    exit_high: Column,
    exit_low: Column,
    atr: Column,
    threshold: Column | float,
) -> Column:
    """Signal of the newest bar: long before short, channel exit below before above."""
    up, down = intensities(close, entry_high, entry_low, atr)
    return (
        F.when(up > threshold, F.lit(LONG))
        .when(down > threshold, F.lit(SHORT))
        .when(close < exit_low, F.lit(EXIT_LONG))
        .when(close > exit_high, F.lit(EXIT_SHORT))
        .otherwise(F.lit(HOLD))
    )


def stop_level(side: Column, close: Column, atr: Column, atr_mult: Column | float) -> Column:
    """Stop price of an entry, NULL where the raw ATR is missing."""
    return F.when(side == LONG, close - atr * atr_mult).when(side == SHORT, close + atr * atr_mult)


def warmup_bars(entry_period: int, atr_period: int) -> int:
    """First position at which the strategy may act."""
    return max(entry_period, atr_period) + 1


def event_side(signal: Column, boolean: bool = False) -> Column:
    """Side of an event row: the value of a signed signal, 1 for a boolean one."""
    return F.when(signal, F.lit(1)) if boolean else F.when(signal != 0, signal.cast("int"))
