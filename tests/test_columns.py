import json
import math

import pytest
from pyspark.sql import functions as F

from sparkbars.functions import features as X
from sparkbars.functions import orders as O
from sparkbars.functions import sizing as Z
from sparkbars.operators.ledger import fill_ledger
from sparkbars.plans import components as C


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_vol_target_formula(spark):
    lit = lambda v: F.lit(float(v))
    for equity, atr, price, mult in [(10_000, 50, 40_000, 2.0), (10_000, 0.01, 40_000, 2.0), (5, 500, 40_000, 4.0)]:
        want = math.floor(min(equity * 0.02 / (mult * atr), equity * 20 / price) / 0.001) * 0.001
        want = want if want >= 0.001 else 0.0
        got = one(spark, Z.vol_target_size(lit(equity), lit(atr), lit(price), mult))[0]
        assert got == pytest.approx(want)
        assert Z.scalar_vol_target_size()(equity, price, None, atr, mult) == pytest.approx(want)
    bad = [(0, 50, 40_000, 2.0), (10_000, 0, 40_000, 2.0), (10_000, 50, 40_000, 0.0)]
    assert all(one(spark, Z.vol_target_size(lit(e), lit(a), lit(p), m))[0] == 0 for e, a, p, m in bad)


def test_stop_distance_directions(spark):
    size = lambda act, stop: Z.stop_distance_size(F.lit(act), F.lit(10_000.0), F.lit(100.0), F.lit(stop))
    assert one(spark, size("BUY", 90.0), size("BUY", 110.0), size("SELL", 110.0), size("SELL", 90.0), size("BUY", 100.0),
               size("BUY", 0.0)) == (20.0, 0.0, 20.0, 0.0, 0.0, 0.0)
    assert one(spark, size("BUY", 99.999))[0] == 2000.0


def test_rounding_and_fills(spark):
    got = one(spark, Z.round_price(F.lit(100.126)), Z.floor_quantity(F.lit(1.2349)),
              Z.fill_price(F.lit("BUY"), F.lit(100.0), 10), Z.fill_price(F.lit("SELL"), F.lit(100.0), 10))
    assert got == pytest.approx((100.13, 1.234, 100.1, 99.9))


def test_gates(spark):
    pos = lambda p, q: O.position_gate(F.lit(p).cast("double"), F.lit(q).cast("boolean"))
    got = one(spark, O.drawdown_gate(F.lit(0.049)), O.drawdown_gate(F.lit(0.05)), O.open_gate(), pos(0.0, False),
              pos(0.0, True), pos(1e-7, False), pos(None, None))
    assert got == (True, False, True, True, False, False, True)


@pytest.mark.parametrize("action,position,pending,size,expected", [
    ("BUY", 0.0, False, 1.0, (True, "BUY", 1.0, False, "ok")),
    ("SELL", 0.0005, False, 1.0, (True, "SELL", 1.0, False, "ok")),
    ("BUY", 0.5, False, 1.0, (False, None, 0.0, False, "in_position")),
    ("BUY", 0.0, True, 1.0, (False, None, 0.0, False, "pending_order")),
    ("BUY", 0.0, False, 0.0, (False, None, 0.0, False, "no_size")),
    ("CLOSE_LONG", 0.5, True, 0.0, (True, "SELL", 0.5, True, "ok")),
    ("CLOSE_LONG", -0.5, False, 0.0, (False, None, 0.0, False, "no_long")),
    ("CLOSE_SHORT", -0.5, False, 0.0, (True, "BUY", 0.5, True, "ok")),
    ("CLOSE_SHORT", 0.0, False, 0.0, (False, None, 0.0, False, "no_short")),
    ("HOLD", 0.0, False, 0.0, (False, None, 0.0, False, "unknown_action")),
])
def test_admission(spark, action, position, pending, size, expected):
    got = one(spark, O.admission(F.lit(action), F.lit(position), F.lit(pending), F.lit(size)))[0]
    assert tuple(got) == expected


def test_intent_json(spark):
    args = [F.lit("BUY"), F.lit("X"), F.lit(0.5), F.lit(100.0), F.lit(90.0), F.lit(1.0)]
    plain, with_tp = one(spark, O.intent_json(O.order_intent(*args, period=7)),
                         O.intent_json(O.order_intent(*args, take_profit=F.lit(120.0))))
    assert json.loads(plain) == {"action": "BUY", "symbol": "X", "quantity": 0.5, "price": 100.0, "stop_price": 90.0,
                                 "trailing_exit": {"indicator": "donchian_low", "period": 7}, "timestamp": 1.0}
    assert json.loads(with_tp)["take_profit"] == 120.0
    with pytest.raises(ValueError):
        O.order_intent(*args, indicator="other")


def test_ledger_rules(spark):
    rows = [  # side, quantity, price, reduce_only
        ("SELL", 1.0, 100.0, True), ("BUY", 1.0, 100.0, False), ("BUY", 1.0, 110.0, False), ("SELL", 0.5, 120.0, False),
        ("SELL", 9.0, 120.0, True), ("SELL", 2.0, 100.0, False), ("BUY", 0.0, 100.0, False), ("BUY", 5.0, 90.0, False),
    ]
    orders = spark.createDataFrame([("a", i, i, "X", *r) for i, r in enumerate(rows)],
                                   "account string, seq long, timestamp_ms long, symbol string, side string, "
                                   "quantity double, price double, reduce_only boolean")
    got = fill_ledger(orders, 1000.0, fee_rate=0.001, slippage_bps=0.0).orderBy("seq").collect()
    assert [(r.seq, r.reason, r.quantity, r.position_after) for r in got] == [
        (1, "open", 1.0, 1.0), (2, "open", 1.0, 2.0), (3, "close", 0.5, 1.5), (4, "close", 1.5, 0.0),
        (5, "open", 2.0, -2.0), (7, "close", 2.0, 0.0)]
    assert [r.pnl for r in got] == pytest.approx([0, 0, 7.5, 22.5, 0, 20.0])
    assert got[-1].balance_after == pytest.approx(1000 + 50 - 0.1 - 0.11 - 0.06 - 0.18 - 0.2 - 0.18)


def test_feature_fallbacks(spark):
    bar = spark.createDataFrame([("X", 0, 100.0)], "symbol string, pos long, close double")
    row = X.compute_features(bar, X.default_feature_set()).first().asDict()
    assert row["atr"] == 0 and row["vol_ratio"] == 1 and row["taker_buy_ratio"] == 0.5 and row["ma_ratio"] == 1
    assert row["long_intensity"] == 0 and row["channel_pos"] == 0.5 and row["channel_width_pct"] == 0
    zero = spark.createDataFrame([("X", 0, 102.0, 0.0, 100.0, 90.0, 100.0)],
                                 "symbol string, pos long, close double, atr double, entry_high double, entry_low double, ma double")
    row = X.compute_features(zero, X.compose([X.breakout_intensity, X.trend_filter, X.channel_width])).first().asDict()
    assert row["long_intensity"] == 2.0 and row["trend_direction"] == 1.0 and row["channel_width_pct"] == pytest.approx(10 / 102)
    assert X.compute_features(bar, X.compose([X.hour_of_day])).first()["hour_of_day"] == 0


def test_components():
    assert C.build(C.LABELERS, {"type": "fixed_horizon", "params": {"horizon": 5}}, "labeler")
    with pytest.raises(ValueError):
        C.build(C.TRIGGERS, {"type": "other"}, "trigger")
    with pytest.raises(ValueError):
        C.build_features([{"type": "other"}])
