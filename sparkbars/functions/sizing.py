"""Position sizes, price rounding and fill prices as columns, with scalar twins for ordered folds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity and price steps of the exchange.
QTY_STEPS_PER_UNIT = 1000
PRICE_TICKS_PER_UNIT = 100

# (equity, entry price, stop price, atr, atr multiple) -> size
ScalarSizer = Callable[[float, float, float | None, float | None, float], float]


def risk_size(
    equity: Column, price: Column, stop: Column, risk_pct: float = 0.02, max_leverage: float = 20.0
) -> Column:
    """Size that loses ``risk_pct`` of equity at the stop, capped by leverage, floored to a thousandth."""
    risk = F.abs(price - stop)
    raw = F.least(equity * risk_pct / risk, equity * max_leverage / price)
    floored = F.floor(raw * QTY_STEPS_PER_UNIT) / QTY_STEPS_PER_UNIT
    return F.when((risk > 0) & (equity > 0), floored).otherwise(F.lit(0.0))


def scalar_risk_size(risk_pct: float = 0.02, max_leverage: float = 20.0) -> ScalarSizer:
    """``risk_size`` for one row inside a fold."""

    def size(equity, price, stop, atr, atr_mult):
        if stop is None or equity <= 0 or price == stop:
            return 0.0
        raw = min(equity * risk_pct / abs(price - stop), equity * max_leverage / price)
        return math.floor(raw * QTY_STEPS_PER_UNIT) / QTY_STEPS_PER_UNIT

    return size


def vol_target_size(
    equity: Column,
    atr: Column,
    price: Column,
    atr_mult: Column | float,
    risk_pct: float = 0.02,
    max_leverage: float = 20.0,
    min_size: float = 0.001,
) -> Column:
    """Volatility target: equity at risk over ``atr_mult`` ATR, capped by leverage, in steps of ``min_size``."""
    mult = atr_mult if isinstance(atr_mult, Column) else F.lit(float(atr_mult))
    distance = mult * atr
    raw = equity * risk_pct / distance
    capped = F.when(price > 0, F.least(raw, equity * max_leverage / price)).otherwise(raw)
    stepped = F.floor(capped / min_size) * min_size
    usable = (equity > 0) & (atr > 0) & (mult > 0) & (distance > 0)
    return F.when(usable & (stepped >= min_size), stepped).otherwise(F.lit(0.0))


def scalar_vol_target_size(
    risk_pct: float = 0.02, max_leverage: float = 20.0, min_size: float = 0.001
) -> ScalarSizer:
    """``vol_target_size`` for one row inside a fold; an unusable ATR counts as 1."""

    def size(equity, price, stop, atr, atr_mult):
        atr = atr if atr is not None and atr > 0 else 1.0
        if equity <= 0 or atr_mult <= 0:
            return 0.0
        raw = equity * risk_pct / (atr_mult * atr)
        if price > 0:
            raw = min(raw, equity * max_leverage / price)
        stepped = math.floor(raw / min_size) * min_size
        return stepped if stepped >= min_size else 0.0

    return size


def stop_distance_size(
    action: Column,
    balance: Column,
    price: Column,
    stop: Column,
    risk_pct: float = 0.02,
    max_leverage: float = 20.0,
) -> Column:
    """Size of an order with direction checks: a BUY stop lies below the price, a SELL stop above."""
    sane = (price > 0) & (stop > 0) & (price != stop)
    directed = F.when(action == "BUY", stop < price).when(action == "SELL", stop > price).otherwise(F.lit(True))
    raw = F.least(balance * risk_pct / F.abs(price - stop), balance * max_leverage / price)
    floored = F.floor(raw * QTY_STEPS_PER_UNIT) / QTY_STEPS_PER_UNIT
    return F.when(sane & directed, floored).otherwise(F.lit(0.0))


def round_price(price: Column) -> Column:
    return F.round(price * PRICE_TICKS_PER_UNIT) / PRICE_TICKS_PER_UNIT


def floor_quantity(quantity: Column) -> Column:
    return F.floor(quantity * QTY_STEPS_PER_UNIT) / QTY_STEPS_PER_UNIT


def fill_price(side: Column, price: Column, slippage_bps: float) -> Column:
    """Price after slippage: a BUY pays more, a SELL gets less."""
    slip = slippage_bps / 10_000.0
    return F.when(side == "BUY", price * (1.0 + slip)).otherwise(price * (1.0 - slip))


def fill_fee(price: Column, quantity: Column, fee_rate: float) -> Column:
    return price * quantity * fee_rate
