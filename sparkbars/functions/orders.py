"""Risk gates, order admission and order records as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkbars.functions.sizing import floor_quantity, round_price

# What counts as a position, and the drawdown that blocks entries.
GATE_POSITION = 1e-8
MIN_POSITION = 0.001
MAX_DRAWDOWN = 0.05
TRAILING_INDICATORS = ["donchian_low", "donchian_high", "moving_average"]


def drawdown_gate(drawdown: Column, max_drawdown: float = MAX_DRAWDOWN) -> Column:
    """Entries allowed while the drawdown is below the limit; at the limit they are blocked."""
    return F.coalesce(drawdown, F.lit(0.0)) < max_drawdown


def open_gate() -> Column:
    return F.lit(True)


def position_gate(position: Column, has_pending: Column) -> Column:
    """Entries allowed only without a pending order and without a position."""
    return ~F.coalesce(has_pending, F.lit(False)) & (F.abs(F.coalesce(position, F.lit(0.0))) <= GATE_POSITION)


def is_position(position: Column) -> Column:
    return F.abs(position) >= MIN_POSITION


def admission(action: Column, position: Column, has_pending: Column, size: Column) -> Column:
    """Struct (admitted, side, quantity, reduce_only, reason) of an order command.

    An unknown position or pending flag blocks an order, as does an unknown size or action.
    """
    unsure = position.isNull() | has_pending.isNull()
    position, has_pending = F.coalesce(position, F.lit(0.0)), F.coalesce(has_pending, F.lit(True))
    action, size = F.coalesce(action, F.lit("")), F.coalesce(size, F.lit(0.0))
    opening = action.isin("BUY", "SELL")
    long_close, short_close = action == "CLOSE_LONG", action == "CLOSE_SHORT"
    reason = (
        F.when(unsure & (opening | long_close | short_close), "unknown_state")
        .when(opening & is_position(position), "in_position")
        .when(opening & has_pending, "pending_order")
        .when(opening & ~(size > 0), "no_size")
        .when(long_close & ~(is_position(position) & (position > 0)), "no_long")
        .when(short_close & ~(is_position(position) & (position < 0)), "no_short")
        .when(~(opening | long_close | short_close), "unknown_action")
        .otherwise("ok")
    )
    ok = reason == "ok"
    side = F.when(opening, action).when(long_close, F.lit("SELL")).when(short_close, F.lit("BUY"))
    return F.struct(
        ok.alias("admitted"),
        F.when(ok, side).alias("side"),
        F.when(ok, F.when(opening, size).otherwise(F.abs(position))).otherwise(F.lit(0.0)).alias("quantity"),
        (ok & ~opening).alias("reduce_only"),
        reason.alias("reason"),
    )


def order_intent(
    action: Column,
    symbol: Column,
    quantity: Column,
    price: Column,
    stop_price: Column,
    timestamp: Column,
    indicator: str = "donchian_low",
    period: int = 14400,
    take_profit: Column | None = None,
) -> Column:
    """Order record with its nested trailing exit; ``to_json`` leaves an unset take-profit out."""
    if indicator not in TRAILING_INDICATORS:
        raise ValueError(f"unknown trailing exit {indicator!r}")
    return F.struct(
        action.alias("action"),
        symbol.alias("symbol"),
        quantity.alias("quantity"),
        price.alias("price"),
        stop_price.alias("stop_price"),
        F.struct(F.lit(indicator).alias("indicator"), F.lit(period).alias("period")).alias("trailing_exit"),
        timestamp.alias("timestamp"),
        (F.lit(None).cast("double") if take_profit is None else take_profit).alias("take_profit"),
    )


def intent_json(intent: Column) -> Column:
    return F.to_json(intent)


def exchange_rounding(price: Column, quantity: Column) -> tuple[Column, Column]:
    """Price to the tick, quantity down to the step."""
    return round_price(price), floor_quantity(quantity)
