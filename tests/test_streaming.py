import datetime as dt
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.functions.signals import last_bar_signal
from sparkbars.operators.indicators import add_channels
from sparkbars.streaming.accounts import stream_accounts
from sparkbars.streaming.entries import Edge, Rule, stream_channels, stream_entries
from sparkbars.streaming.order_states import stream_orders
from sparkbars.streaming.routing import route
from sparkbars.streaming.state import BUCKETS, replay_of, run_counted
from tests.data import frame, walk

RULE = Rule(12, 6, 8, 2.0, 0.0)
CHANNELS = ["entry_high", "entry_low", "exit_high", "exit_low", "atr"]


def drive(spark, build, batches, base):
    """Feed batches one by one through one query and return everything it wrote."""
    src, out = f"{base}/in", f"{base}/out"
    stream = None
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(batch.schema).parquet(src))
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/cp")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).toPandas()


@pytest.fixture
def bars():
    return pd.concat([walk(61, 200, "A"), walk(62, 200, "B", step=2.0)])


def _batch_channels(spark, bars):
    table = add_channels(frame(spark, bars), [12], [6], [8])
    names = dict(zip(CHANNELS, ["high_12", "low_12", "high_6", "low_6", "atr_8"]))
    return table.select("symbol", "pos", "open_time", "close", *[F.col(c).alias(n) for n, c in names.items()])


def _compare(got, want):
    got = got.sort_values(["symbol", "pos"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "pos"]).reset_index(drop=True)
    assert list(got.pos) == list(want.pos)
    for c in CHANNELS:
        pd.testing.assert_series_equal(got[c], want[c], check_names=False, rtol=1e-12)


def test_channels_over_batches_equal_batch_job(spark, bars, tmp_path):
    cuts = [bars[bars.pos < 5], bars[(bars.pos >= 5) & (bars.pos < 90)], bars[bars.pos >= 90]]
    got = drive(spark, lambda s: stream_channels(s, RULE), [frame(spark, b) for b in cuts], str(tmp_path))
    _compare(got, _batch_channels(spark, bars).toPandas())


def test_late_and_repeated_bars_are_dropped_and_counted(spark, bars, tmp_path):
    cuts = [bars[bars.pos < 90], bars[(bars.pos >= 80) & (bars.pos < 150)], bars[bars.pos >= 150]]
    got = drive(spark, lambda s: stream_channels(s, RULE), [frame(spark, b) for b in cuts], str(tmp_path))
    _compare(got, _batch_channels(spark, bars).toPandas())
    assert got[got.pos == 199].late_bars.tolist() == [10, 10]


@pytest.mark.parametrize("rule", [RULE, Rule(70, 90, 130, 2.0, 0.0)])
def test_replay_of_100_rows_a_trigger_equals_the_batch_job(spark, rule):
    bars = pd.concat([walk(63, 500, "A"), walk(64, 450, "B", step=2.0)])
    bars.loc[(bars.symbol == "A") & bars.pos.isin([41, 42, 300]), ["high", "close"]] = None
    stream = replay_of(frame(spark, bars), ["open_time", "symbol"], 100)
    got, counts = run_counted(stream_channels(stream, rule))
    table = add_channels(frame(spark, bars), [rule.entry_period], [rule.exit_period], [rule.atr_period])
    names = [f"high_{rule.entry_period}", f"low_{rule.entry_period}", f"high_{rule.exit_period}", f"low_{rule.exit_period}", f"atr_{rule.atr_period}"]
    _compare(got.toPandas(), table.select("symbol", "pos", *[F.col(c).alias(n) for n, c in zip(CHANNELS, names)]).toPandas())
    assert counts["triggers"] >= 9 and counts["late"] == counts["repeated"] == 0


def test_watermark_drops_repeated_and_late_bars_across_triggers(spark, tmp_path):
    bars = pd.concat([walk(65, 200, "A"), walk(66, 200, "B")])
    step = bars.open_time.diff().dropna().median()
    batches = [bars[bars.pos < 90], pd.concat([bars[(bars.pos >= 85) & (bars.pos < 150)], bars[bars.pos == 100]]), bars[(bars.pos >= 150) | (bars.pos == 3)]]
    delay = f"{int(20 * step)} milliseconds"
    got = drive(spark, lambda s: stream_channels(s, RULE, delay=delay), [frame(spark, b) for b in batches], str(tmp_path))
    _compare(got, _batch_channels(spark, bars).toPandas())
    # repeats within the delay never reach the channels, so nothing is left to count there
    assert got[got.pos == 199].late_bars.tolist() == [0, 0]


def test_dropped_rows_are_reported(spark):
    bars = walk(67, 300, "A")
    again = pd.concat([bars, bars[bars.pos % 10 == 0]])
    out, counts = run_counted(stream_channels(replay_of(frame(spark, again), ["open_time"], 100), RULE, delay="1 day"))
    assert out.count() == 300 and counts["repeated"] == 30


def test_entries_do_not_depend_on_the_rows_per_trigger(spark, bars):
    closes = _batch_channels(spark, bars).filter("pos >= 12").withColumn(
        "code", last_bar_signal(*[F.col(c) for c in ("close", *CHANNELS)], 0.0)).filter("abs(code) = 2")
    marked = frame(spark, bars).join(closes.select("symbol", "open_time", F.lit(True).alias("closing")), ["symbol", "open_time"], "left")

    def run(rows):
        stream = replay_of(marked, ["open_time", "symbol"], rows)
        return sorted(map(tuple, run_counted(stream_entries(stream, stream.filter("closing"), RULE))[0].collect()))

    assert run(100) == run(1 << 20) != []


def test_state_holds_candidates_not_windows():
    edge = Edge(1000, 1)
    for pos, value in enumerate(walk(68, 5000).high):
        assert edge.before(pos, -1) == (None if pos < 1000 else max(v for _, v in list(seen)))
        edge.push(pos, value)
        if pos == 0:
            seen = deque(maxlen=1000)
        seen.append((pos, value))
    assert len(edge.kept) < 200


def test_history_warms_the_state(spark, bars, tmp_path):
    history, live = bars[bars.pos < 100], bars[bars.pos >= 100]
    got = drive(spark, lambda s: stream_channels(s, RULE, frame(spark, history)), [frame(spark, live)], str(tmp_path))
    _compare(got, _batch_channels(spark, bars).filter("pos >= 100").toPandas())


def test_entries_wait_for_the_close(spark, bars, tmp_path):
    table = _batch_channels(spark, bars)
    signal = last_bar_signal(*[F.col(c) for c in ("close", *CHANNELS)], 0.0)
    coded = table.withColumn("code", signal).filter("pos >= 12").toPandas()
    closes = coded[coded.code.abs() == 2][["symbol", "open_time"]]
    want = []
    for symbol, d in coded.sort_values("pos").groupby("symbol"):
        idle = True
        for r in d.itertuples():
            idle = idle or abs(r.code) == 2
            if idle and abs(r.code) == 1:
                want.append((symbol, r.pos, r.code))
                idle = False
    merged = bars.merge(closes.assign(closing=True), "left", ["symbol", "open_time"])
    merged["closing"] = merged.closing.eq(True)
    cuts = [merged[merged.pos < 77], merged[merged.pos >= 77]]

    def build(s):
        return stream_entries(s, s.filter("closing"), RULE)

    got = drive(spark, build, [frame(spark, b) for b in cuts], str(tmp_path))
    assert sorted(zip(got.symbol, got.pos, got.side)) == sorted(want) and len(want) > 5
    assert (got["size"] > 0).all()


def test_blocked_entries_do_not_change_the_state(spark, bars, tmp_path):
    def build(s):
        return stream_entries(s, s.filter("false"), RULE, allowed=F.col("pos") >= 120)

    got = drive(spark, build, [frame(spark, bars)], str(tmp_path))
    assert len(got) == 2 and (got.pos >= 120).all()


def _order(cid, at, status=None, filled=0.0, attempts=0):
    t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at)
    return (cid, t, status is not None, status, filled, "X", "BUY", 1.0, 100.0, attempts)


ORDER_SCHEMA = ("client_order_id string, ts timestamp, is_update boolean, status string, filled_quantity double, "
                "symbol string, side string, quantity double, price double, attempts int")


def test_order_lifecycle(spark, tmp_path):
    batches = [
        [_order("a", 0), _order("b", 0), _order("c", 0, attempts=2), _order("z", 1, "FILLED", 1.0)],
        [_order("a", 60, "PARTIALLY_FILLED", 0.4), _order("b", 70, "FILLED", 1.0)],
        [_order("b", 80, "FILLED", 1.0), _order("d", 90), _order("a", 200, "CANCELED", 0.4)],
        [_order("e", 2000)],
        [_order("b", 2100, "CANCELED", 1.0)],
    ]
    got = drive(spark, stream_orders, [spark.createDataFrame(b, ORDER_SCHEMA) for b in batches], str(tmp_path))
    rows = {r.client_order_id: (r.status, r.filled_quantity, r.reason, r.action) for r in got.itertuples()}
    assert len(got) == len(rows)
    assert rows == {
        "a": ("CANCELED", 0.4, "timeout", "cancel_reprice"),
        "b": ("FILLED", 1.0, "exchange", "report"),
        "c": ("CANCELED", 0.0, "timeout_exhausted", "cancel"),
        "d": ("CANCELED", 0.0, "timeout", "cancel_reprice"),
    }
    at = {r.client_order_id: (r.at_ms - 1704067200000) // 1000 for r in got.itertuples()}
    assert at == {"a": 180, "b": 70, "c": 180, "d": 270}


def test_accounts_over_batches(spark, tmp_path):
    schema = "account string, ts_us long, tie long, balance double, position double, entry_price double, stop_price double"
    batches = [
        [("u", 1, 1, 100.0, None, None, None), ("u", 2, 2, None, 1.5, 10.0, 9.0)],
        [("u", 3, 3, 90.0, None, None, None), ("u", 4, 4, None, 0.0005, None, None)],
        [("u", 5, 5, None, -2.0, None, None), ("u", 6, 6, None, None, 11.0, None)],
    ]
    got = drive(spark, stream_accounts, [spark.createDataFrame(b, schema) for b in batches], str(tmp_path))
    got = got.sort_values("seq")
    assert list(got.seq) == [1, 2, 3, 4, 5, 6]
    assert list(got.position) == [0, 1.5, 1.5, 0, -2, -2]
    assert list(got.entry_price) == [0, 10, 10, 0, 0, 11]
    assert list(got.stop_price) == [0, 9, 9, 0, 0, 0]
    assert list(got.balance) == [100, 100, 90, 90, 90, 90]


def groups_and_rows(stream, base):
    """What a stream wrote over all its triggers, and the most state rows it held."""
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    held = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    return held, stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").collect()


def test_orders_share_groups(spark, tmp_path):
    n = 3 * BUCKETS
    rows = [_order(f"o{i}", i % 50, attempts=i % 3) for i in range(n)]
    rows += [_order(f"o{i}", 60 + i % 7, "FILLED", float(i)) for i in range(0, n, 2)]
    late = [_order(None, 9000), _order("last", 10_000)]
    for batch in (rows, late):
        spark.createDataFrame(batch, ORDER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ORDER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held, got = groups_and_rows(stream_orders(stream), str(tmp_path))
    # a row of state and two of its timer each
    assert held <= 3 * BUCKETS
    start = 1704067200000
    want = {f"o{i}": ("report", float(i), start + 1000 * (60 + i % 7)) if i % 2 == 0 else
            ("cancel" if i % 3 == 2 else "cancel_reprice", 0.0, start + 1000 * (i % 50 + 180)) for i in range(n)}
    want[None] = ("cancel_reprice", 0.0, start + 9_180_000)
    assert len(got) == n + 1 and {r["client_order_id"]: (r["action"], r["filled_quantity"], r["at_ms"]) for r in got} == want


def test_accounts_share_groups(spark, tmp_path):
    schema = "account string, ts_us long, tie long, balance double, position double, entry_price double, stop_price double"
    n = 3 * BUCKETS
    names = [None, *[f"u{i}" for i in range(1, n)]]
    for ts in (10, 30, 20):  # the last trigger is late, but for one account
        rows = [(a, 100 if ts == 20 and i == 5 else ts, 0, float(ts + i), None, None if i % 2 else float(i), None) for i, a in enumerate(names)]
        rows += [(a, 11, 0, None, float(i), 7.0, 6.0) for i, a in enumerate(names) if ts == 10]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held, got = groups_and_rows(stream_accounts(stream), str(tmp_path))
    assert held <= BUCKETS
    got = {(r["account"], r["seq"]): (r["ts_us"], r["balance"], r["position"], r["entry_price"], r["stop_price"], r["is_flat"], r["n_late"]) for r in got}
    want = {}
    for i, a in enumerate(names):
        want[a, 1] = (10, 10.0 + i, 0.0, 0.0, 0.0, True, 0)
        want[a, 2] = (11, 10.0 + i, float(i), 7.0 if i else 0.0, 6.0 if i else 0.0, i == 0, 0)
        want[a, 3] = (30, 30.0 + i, float(i), want[a, 2][3] if i % 2 else float(i), want[a, 2][4], i == 0, 0)
    want["u5", 4] = (100, 25.0, 5.0, 7.0, 6.0, False, 0)
    assert got == want


def test_routing(spark):
    messages = spark.createDataFrame([('{"type":"ack"}',), ('{"type":"kline","symbol":"X","close":1.5}',)], "value string")
    assert [tuple(r) for r in route(messages, "kline", "symbol string, close double").collect()] == [("X", 1.5)]
