"""Fill ledgers: position, average entry, realised profit and balance fill by fill."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from sparkbars.operators.fold import ordered_fold
from sparkbars.schema import LEDGER_COLUMNS

# Replay fees and the smallest position that counts.
FEE_RATE = 0.0005
SLIPPAGE_BPS = 1.0
DUST = 1e-12
MIN_POSITION = 0.001

_SCHEMA = (
    "account string, seq long, timestamp_ms long, symbol string, side string, quantity double, price double, "
    "fee double, pnl double, balance_after double, position_after double, reason string"
)


def fill_ledger(
    orders: DataFrame,
    initial_balance: float = 10_000.0,
    fee_rate: float = FEE_RATE,
    slippage_bps: float = SLIPPAGE_BPS,
) -> DataFrame:
    """Ledger rows of accepted orders per account, in ``seq`` order.

    ``orders``: account, seq, timestamp_ms, symbol, side, quantity, price, reduce_only.
    An order against the position, or a reduce-only one, closes at most the position;
    an order with it adds at the average entry. Orders that can do neither leave no row.
    """
    slip = slippage_bps / 10_000.0

    def step(rows: pd.DataFrame, state):
        balance, position, entry = state or (initial_balance, 0.0, 0.0)
        out = []
        for r in rows.itertuples(index=False):
            if r.quantity <= 0 or r.price <= 0 or r.side not in ("BUY", "SELL"):
                continue
            sign = 1.0 if r.side == "BUY" else -1.0
            price = r.price * (1.0 + sign * slip)
            if r.reduce_only or sign * position < 0:
                qty = min(r.quantity, abs(position))
                if qty <= 0:
                    continue
                holding = 1.0 if position > 0 else -1.0
                pnl = holding * (price - entry) * qty
                position -= holding * qty
                if abs(position) < DUST:
                    position, entry = 0.0, 0.0
                reason = "close"
            else:
                qty, pnl, held = r.quantity, 0.0, abs(position)
                entry = price if held == 0 else (entry * held + price * qty) / (held + qty)
                position += sign * qty
                reason = "open"
            fee = price * qty * fee_rate
            balance += pnl - fee
            if abs(position) < MIN_POSITION:
                # Too small to count: the account treats it as flat; an opening fill keeps its entry price.
                position = 0.0
                entry = entry if reason == "open" else 0.0
            out.append((r.account, r.seq, r.timestamp_ms, r.symbol, r.side, qty, price, fee, pnl, balance, position, reason))
        columns = ["account", "seq", *LEDGER_COLUMNS]
        return pd.DataFrame(out, columns=columns), (balance, position, entry)

    columns = ["account", "seq", "timestamp_ms", "symbol", "side", "quantity", "price", "reduce_only"]
    return ordered_fold(orders.select(*columns), ["account"], ["seq"], step, _SCHEMA)
