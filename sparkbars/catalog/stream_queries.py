"""Streaming jobs run over everything the tables hold, read back as tables."""

from pyspark.sql import functions as F

from sparkbars.catalog.inputs import event_bars, event_bars_sql, table
from sparkbars.catalog.registry import ctes, register, rounded
from sparkbars.catalog.trade_queries import ONE_RUN, runs_sql
from sparkbars.functions.signals import last_bar_signal
from sparkbars.operators.indicators import add_channels
from sparkbars.operators.running import Running, running
from sparkbars.session import cut
from sparkbars.streaming.accounts import stream_accounts
from sparkbars.streaming.entries import Rule, stream_channels, stream_entries
from sparkbars.streaming.order_states import stream_orders
from sparkbars.streaming.routing import route
from sparkbars.streaming.state import replay_of, run_available, run_counted, stream_of

TIMES = ["open_time", "symbol"]

_LAST = """
coded AS (SELECT *, CASE WHEN (close - eh) / unit > 0 THEN 1 WHEN (el - close) / unit > 0 THEN -1
                         WHEN close < xl THEN 2 WHEN close > xh THEN -2 ELSE 0 END AS code FROM perrun WHERE pos >= 20)
"""


def _bar_table(spark, sf):
    return cut(event_bars(spark, sf).select("symbol", "pos", "open_time", "high", "low", "close"))


@register(
    "stream_channels",
    ctes(event_bars_sql(), runs_sql(ONE_RUN))
    + """SELECT symbol, pos, open_time, round(eh, 6) AS entry_high, round(el, 6) AS entry_low, round(xh, 6) AS exit_high,
    round(xl, 6) AS exit_low, round(atr, 6) AS atr FROM perrun""",
)
def channels(spark, sf):
    out = run_available(stream_channels(replay_of(_bar_table(spark, sf), TIMES), Rule()))
    return rounded(out.select("symbol", "pos", "open_time", "entry_high", "entry_low", "exit_high", "exit_low", "atr"))


AGAIN_EVERY = 7


@register(
    "stream_repeated_bars",
    ctes(event_bars_sql(), runs_sql(ONE_RUN)) + f"""SELECT symbol, pos, open_time, round(eh, 6) AS entry_high, round(atr, 6) AS atr,
      (SELECT CAST(count(*) AS BIGINT) FROM bars WHERE pos % {AGAIN_EVERY} = 0) AS repeated FROM perrun""",
)
def repeated_bars(spark, sf):
    """Every seventh bar comes twice; the watermark de-duplication drops it before it reaches the channels."""
    bars = _bar_table(spark, sf)
    twice = cut(bars.unionByName(bars.filter(F.col("pos") % AGAIN_EVERY == 0)))
    out, counts = run_counted(stream_channels(replay_of(twice, TIMES), Rule(), delay="1 day"))
    return rounded(out.select("symbol", "pos", "open_time", "entry_high", "atr", F.lit(counts["repeated"]).cast("long").alias("repeated")))


@register(
    "stream_entries",
    ctes(event_bars_sql(), runs_sql(ONE_RUN), _LAST, """
segments AS (SELECT *, count(*) FILTER (abs(code) = 2) OVER (PARTITION BY symbol ORDER BY pos) AS seg,
    CASE WHEN code = 1 THEN close - atr * 2 ELSE close + atr * 2 END AS stop_price FROM coded),
entries AS (SELECT *, floor(least(10000 * 0.02::DOUBLE / abs(close - stop_price), 10000 * 20::DOUBLE / close) * 1000) / 1000 AS size
  FROM segments WHERE abs(code) = 1),
firsts AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY pos) AS rn FROM entries WHERE size > 0)""")
    + """SELECT symbol, pos, open_time, code AS side, round(close, 6) AS entry_price, round(stop_price, 6) AS stop_price,
    round(size, 6) AS size FROM firsts WHERE rn = 1""",
)
def entries(spark, sf):
    bars = _bar_table(spark, sf)
    run = ONE_RUN[0]
    channels = add_channels(bars, [run.entry_period], [run.exit_period], [run.atr_period])
    args = [F.col(c) for c in ("close", "high_20", "low_20", "high_10", "low_10", "atr_20")]
    # The channel exit of a bar stands for the message that the position was closed.
    closed = channels.filter((F.col("pos") >= 20) & (F.abs(last_bar_signal(*args, 0.0)) == 2))
    # one source for both, so that a trigger holds the bars and the messages of the same time
    marked = bars.join(closed.select("symbol", "open_time", F.lit(True).alias("closing")), ["symbol", "open_time"], "left")
    stream = replay_of(marked, TIMES)
    out = run_available(stream_entries(stream, stream.filter("closing"), Rule()))
    return rounded(out.drop("score"))


@register(
    "stream_accounts",
    """WITH u AS (
      SELECT CAST(user_id AS VARCHAR) AS account, epoch_us(ts) AS ts_us, event_id,
        CASE event_type WHEN 'view' THEN 10000 + value END AS balance,
        CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = event_id % 2 THEN value ELSE 0.0005 END END AS position,
        CASE event_type WHEN 'click' THEN value END AS entry_price, CASE event_type WHEN 'error' THEN value END AS stop_price FROM events),
    p AS (SELECT *, coalesce(last_value(position IGNORE NULLS) OVER w, 0) AS pos, coalesce(last_value(balance IGNORE NULLS) OVER w, 0) AS bal,
        row_number() OVER w AS seq FROM u
      WINDOW w AS (PARTITION BY account ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, abs(pos) < 0.001 AS is_flat FROM p)
    SELECT account, seq, ts_us, CAST(0 AS BIGINT) AS n_late, bal AS balance, CASE WHEN is_flat THEN 0 ELSE pos END AS position, is_flat,
      coalesce(last_value(CASE WHEN is_flat THEN 0 ELSE entry_price END IGNORE NULLS) OVER w, 0) AS entry_price,
      coalesce(last_value(CASE WHEN is_flat THEN 0 ELSE stop_price END IGNORE NULLS) OVER w, 0) AS stop_price
    FROM f WINDOW w AS (PARTITION BY account ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)""",
)
def accounts(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    same = F.col("user_id") % 2 == F.col("event_id") % 2
    updates = cut(table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("account"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("tie"),
        F.when(kind == "view", value + 10_000).alias("balance"),
        F.when(kind == "purchase", F.when(same, value).otherwise(F.lit(0.0005))).alias("position"),
        F.when(kind == "click", value).alias("entry_price"),
        F.when(kind == "error", value).alias("stop_price"),
    ))
    return run_available(stream_accounts(replay_of(updates, ["ts_us", "tie"])))


_ORDERS_SQL = """
WITH e AS (
  SELECT *, epoch_us(ts) // 1000 AS ms, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS oid
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (
  SELECT event_id AS oid, user_id, ms AS created, ms + 7200000 AS deadline, value AS quantity, 100 + value AS price,
    CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(user_id % 4 AS INTEGER) AS attempts
  FROM e WHERE event_type = 'view'),
u AS (
  SELECT e.oid, e.ms, e.ts, e.event_id, e.value AS filled, o.deadline,
    CASE event_type WHEN 'click' THEN 'PARTIALLY_FILLED' WHEN 'purchase' THEN 'FILLED' WHEN 'error' THEN 'CANCELED' ELSE 'NEW' END AS status
  FROM e JOIN o ON o.oid = e.oid WHERE event_type <> 'view'),
ended AS (
  SELECT oid, arg_min(status, (ts, event_id)) AS status, arg_min(filled, (ts, event_id)) AS filled, min(ms) AS at_ms
  FROM u WHERE status IN ('FILLED', 'CANCELED') AND ms < deadline GROUP BY oid),
seen AS (SELECT oid, arg_max(filled, (ts, event_id)) AS filled FROM u WHERE ms < deadline GROUP BY oid),
rows AS (
  SELECT o.oid, o.user_id, o.side, o.quantity, o.price, d.status, d.filled, 'exchange' AS reason, 'report' AS action, d.at_ms
  FROM o JOIN ended d ON d.oid = o.oid
  UNION ALL
  SELECT o.oid, o.user_id, o.side, o.quantity, o.price, 'CANCELED', coalesce(s.filled, 0),
    CASE WHEN attempts >= 2 THEN 'timeout_exhausted' ELSE 'timeout' END, CASE WHEN attempts >= 2 THEN 'cancel' ELSE 'cancel_reprice' END, o.deadline
  FROM o LEFT JOIN seen s ON s.oid = o.oid
  WHERE NOT EXISTS (SELECT 1 FROM ended d WHERE d.oid = o.oid) AND o.deadline <= (SELECT max(ms) FROM e))
SELECT CAST(oid AS VARCHAR) AS client_order_id, CAST(user_id AS VARCHAR) AS symbol, side, quantity, price, status,
  filled AS filled_quantity, reason, action, at_ms FROM rows
"""


@register("stream_orders", _ORDERS_SQL)
def orders(spark, sf):
    # A view places an order, the user's next events report on it; two hours is the deadline here.
    e = table(spark, sf, "events")
    rows = e.select(
        "user_id", "event_id", "event_type", "value", "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(F.col("event_type") == "view", F.col("event_id")).alias("_view"),
    ).withColumn("_day", F.floor(F.col("us") / 86_400_000_000))
    owned = running(rows, ["user_id"], "_day", "us", [Running("order", "last", F.col("_view"))]).filter("order IS NOT NULL")
    kind = F.col("event_type")
    messages = cut(owned.select(
        F.col("order").cast("string").alias("client_order_id"),
        "ts",
        (kind != "view").alias("is_update"),
        F.when(kind == "click", "PARTIALLY_FILLED").when(kind == "purchase", "FILLED")
        .when(kind == "error", "CANCELED").otherwise("NEW").alias("status"),
        F.col("value").alias("filled_quantity"),
        F.col("user_id").cast("string").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("quantity"),
        (F.col("value") + 100).alias("price"),
        (F.col("user_id") % 4).cast("int").alias("attempts"),
    ))
    return run_available(stream_orders(stream_of(messages), timeout_ms=7_200_000, prune_ms=14_400_000))


@register(
    "stream_routing",
    """SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'""",
)
def routing(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "order_update").when(F.col("event_type") == "error", "ack").otherwise("kline")
    messages = cut(table(spark, sf, "events").select(
        F.to_json(F.struct(kind.alias("type"), "event_id", "user_id", "value")).alias("value")
    ))
    return run_available(route(stream_of(messages), "order_update", "event_id long, user_id long, value double"))
