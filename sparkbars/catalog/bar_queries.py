"""Ingest, positions and indicators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.catalog.inputs import (
    DAILY_BARS_SQL,
    HOUR,
    PERIODS,
    TEN_MINUTES,
    daily_bars,
    event_bars,
    event_bars_sql,
    table,
)
from sparkbars.catalog.registry import ctes, r6, register, rounded
from sparkbars.operators.indicators import add_indicators
from sparkbars.schema import CSV_COLUMNS
from sparkbars.sources import bars as B

PRICES = "open high low close volume taker_buy_base"


@register(
    "bars_hourly",
    ctes(event_bars_sql(HOUR)) + f"SELECT symbol, pos, open_time, {r6(PRICES)}, trades_count FROM bars",
)
def bars_hourly(spark, sf):
    return rounded(event_bars(spark, sf, HOUR))


@register("bars_daily", ctes(DAILY_BARS_SQL) + "SELECT * FROM bars")
def bars_daily(spark, sf):
    return daily_bars(spark, sf)


@register(
    "bars_date_range",
    ctes(event_bars_sql())
    + f"""SELECT symbol, pos, open_time, {r6(PRICES)}, trades_count FROM bars
    WHERE open_time >= epoch_ms(TIMESTAMP '2024-01-05') AND open_time < epoch_ms(TIMESTAMP '2024-01-20')""",
)
def bars_date_range(spark, sf):
    return rounded(B.date_filter(event_bars(spark, sf), "2024-01-05", "2024-01-20"))


def _as_klines(bars: DataFrame, width_ms: int = TEN_MINUTES) -> DataFrame:
    """Event bars with the full kline columns; quote columns use the close."""
    return bars.select(
        "symbol", "open_time", "open", "high", "low", "close", "volume",
        (F.col("open_time") + width_ms - 1).alias("close_time"),
        (F.col("volume") * F.col("close")).alias("quote_volume"),
        "trades_count", "taker_buy_base",
        (F.col("taker_buy_base") * F.col("close")).alias("taker_buy_quote"),
    )


_KLINES_SQL = f"""
klines AS (
  SELECT symbol, open_time, open, high, low, close, volume, open_time + {TEN_MINUTES} - 1 AS close_time,
         volume * close AS quote_volume, trades_count, taker_buy_base, taker_buy_base * close AS taker_buy_quote
  FROM bars)
"""
_KLINE_DOUBLES = "open high low close volume quote_volume taker_buy_base taker_buy_quote"
_KLINE_SELECT = f"symbol, open_time, close_time, trades_count, {r6(_KLINE_DOUBLES)}"


@register(
    "klines_normalized",
    """SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS open_time,
      CAST(l_orderkey AS DOUBLE) AS open, l_extendedprice AS high, l_discount AS low, l_tax AS close,
      l_quantity AS volume, epoch_ms(l_shipdate) + 1 AS close_time, CAST(l_partkey AS DOUBLE) AS quote_volume,
      CAST(l_linenumber AS BIGINT) AS trades_count,
      CASE WHEN l_linestatus = 'O' THEN l_quantity END AS taker_buy_base,
      CAST(l_suppkey AS DOUBLE) AS taker_buy_quote
    FROM lineitem WHERE l_returnflag <> 'N'""",
)
def klines_normalized(spark, sf):
    # Raw text rows: keys of one flag and a flow column are not numbers in part of them.
    lines = table(spark, sf, "lineitem")
    ms = B.epoch_ms("l_shipdate")
    raw = lines.select(
        F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_returnflag") == "N", "n/a").otherwise(ms.cast("string")).alias("c0"),
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(
            ("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"), 1)],
        (ms + 1).cast("string").alias("c6"),
        F.col("l_partkey").cast("string").alias("c7"),
        F.col("l_linenumber").cast("string").alias("c8"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).otherwise("-").alias("c9"),
        F.col("l_suppkey").cast("string").alias("c10"),
        F.lit("0").alias("c11"),
    )
    return B.normalize_klines(raw)


@register(
    "bars_dedup",
    ctes(
        """prints AS (SELECT o_orderpriority AS symbol, epoch_ms(o_orderdate) AS open_time, o_orderkey AS batch_seq,
        o_totalprice AS close FROM orders)"""
    )
    + """SELECT symbol, open_time, arg_max(close, batch_seq) AS close,
      strftime(to_timestamp(open_time / 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS datetime
    FROM prints GROUP BY symbol, open_time""",
)
def bars_dedup(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), B.epoch_ms("o_orderdate").alias("open_time"),
        F.col("o_orderkey").alias("batch_seq"), F.col("o_totalprice").alias("close"),
    )
    merged = B.merge_increments(rows)
    return merged.select(
        "symbol", "open_time", "close", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime")
    )


@register(
    "resume_increment",
    ctes(
        event_bars_sql(),
        """stored AS (SELECT * FROM bars WHERE symbol <> 'view' AND
           open_time < epoch_ms(TIMESTAMP '2024-01-10') + (CASE WHEN symbol = 'click' THEN 86400000 ELSE 0 END)),
        marks AS (SELECT symbol, max(open_time) AS high FROM stored GROUP BY symbol)""",
    )
    + f"""SELECT b.symbol, b.pos, b.open_time, {r6('close volume', 'b')} FROM bars b
    LEFT JOIN marks m ON b.symbol = m.symbol WHERE m.high IS NULL OR b.open_time >= m.high + 60000""",
)
def resume_increment(spark, sf):
    bars = event_bars(spark, sf).select("symbol", "pos", "open_time", "close", "volume")
    late = F.when(F.col("symbol") == "click", 86_400_000).otherwise(0)
    until = B.epoch_ms(F.lit("2024-01-10").cast("timestamp")) + late
    stored = bars.filter((F.col("symbol") != "view") & (F.col("open_time") < until))
    return rounded(B.resume_increment(stored, bars))


@register(
    "funding_merged",
    """SELECT strftime(make_timestamp(calc_time * 1000), '%Y-%m-%d %H:%M:%S') AS datetime, calc_time,
      arg_max(funding_rate, k) AS funding_rate
    FROM (SELECT epoch_ms(o_orderdate) AS calc_time, o_totalprice / 1000000 AS funding_rate,
            (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) * 1000000000 + o_orderkey AS k
          FROM orders)
    GROUP BY calc_time""",
)
def funding_merged(spark, sf):
    orders = table(spark, sf, "orders")
    ms, rate = B.epoch_ms("o_orderdate"), F.col("o_totalprice") / 1_000_000

    def newest(rows):
        keyed = rows.withColumn("t", ms)
        return B.latest_per_key(keyed, ["t"], ["o_orderkey"])

    old = newest(orders.filter("o_orderstatus = 'F'")).select(
        ms.cast("string").alias("a"), rate.cast("string").alias("b"))
    new = newest(orders.filter("o_orderstatus <> 'F'")).select(
        ms.cast("string").alias("calc_time"), rate.cast("string").alias("last_funding_rate"))
    merged = B.merge_funding(B.normalize_funding(old), B.normalize_funding(new))
    return merged.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


@register(
    "csv_export_rows",
    ctes(event_bars_sql(), _KLINES_SQL)
    + f"""SELECT {_KLINE_SELECT} FROM klines
    WHERE open_time BETWEEN epoch_ms(TIMESTAMP '2024-01-03') AND epoch_ms(TIMESTAMP '2024-01-25 12:00:00')""",
)
def csv_export_rows(spark, sf):
    bars = _as_klines(event_bars(spark, sf))
    twice = bars.unionByName(bars)
    lo, hi = 1_704_240_000_000, 1_706_184_000_000  # 2024-01-03 00:00 and 2024-01-25 12:00
    return rounded(B.csv_export_rows(twice, lo, hi))


@register(
    "bars_from_messages",
    ctes(event_bars_sql(), _KLINES_SQL)
    + f"SELECT {_KLINE_SELECT}, trades_count > 1 AS is_closed FROM klines",
)
def bars_from_messages(spark, sf):
    k = _as_klines(event_bars(spark, sf))
    text = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "q": "quote_volume",
            "V": "taker_buy_base", "Q": "taker_buy_quote"}
    whole = {"t": "open_time", "T": "close_time", "n": "trades_count"}
    # Written by hand because the message has field names that differ only by case.
    parts = [F.concat(F.lit(f'"{a}":"'), F.col(c).cast("string"), F.lit('"')) for a, c in text.items()]
    parts += [F.concat(F.lit(f'"{a}":'), F.col(c).cast("string")) for a, c in whole.items()]
    parts.append(F.concat(F.lit('"x":'), (F.col("trades_count") > 1).cast("string")))
    message = F.concat(F.lit('{"s":"'), F.col("symbol"), F.lit('","k":{'), F.concat_ws(",", *parts), F.lit("}}"))
    return rounded(B.bars_from_messages(k.select(message.alias("value"))))


@register(
    "bars_from_rest",
    ctes(event_bars_sql(), _KLINES_SQL) + f"SELECT {_KLINE_SELECT}, true AS is_closed FROM klines",
)
def bars_from_rest(spark, sf):
    k = _as_klines(event_bars(spark, sf))
    row = F.to_json(F.array(*[F.col(c).cast("string") for c in CSV_COLUMNS]))
    return rounded(B.bars_from_rest(k.select("symbol", row.alias("value"))))


@register(
    "closed_bar_records",
    ctes(event_bars_sql(), _KLINES_SQL) + f"SELECT {_KLINE_SELECT} FROM klines WHERE trades_count > 1",
)
def closed_bar_records(spark, sf):
    k = _as_klines(event_bars(spark, sf))
    record = F.to_json(F.struct(F.lit("kline").alias("type"), *k.columns, (F.col("trades_count") > 1).alias("is_closed")))
    closed = B.closed_bars(B.bar_records(k.select(record.alias("value"))))
    return rounded(closed.select("symbol", *CSV_COLUMNS))


# ---- indicators ----------------------------------------------------------------------------------

_P = PERIODS


def _frame(name: str, rows: int, current: bool = False) -> str:
    lo, hi = (rows - 1, "CURRENT ROW") if current else (rows, "1 PRECEDING")
    return f"{name} AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {lo} PRECEDING AND {hi})"


def _guard(how: str, column: str, window: str, rows: int) -> str:
    return f"CASE WHEN count({column}) OVER {window} = {rows} THEN {how}({column}) OVER {window} END"


INDICATORS_SQL = f"""
ranged AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
         CASE WHEN volume > 0 THEN ln(volume) END AS log_volume,
         close / lag(close, 5) OVER s - 1 AS ret_5, close / lag(close, 10) OVER s - 1 AS ret_10,
         close / lag(close, 30) OVER s - 1 AS ret_30
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY pos)),
rolled AS (
  SELECT *, {_guard('max', 'high', 'e', _P['entry_period'])} AS entry_high,
         {_guard('min', 'low', 'e', _P['entry_period'])} AS entry_low,
         {_guard('max', 'high', 'x', _P['exit_period'])} AS exit_high,
         {_guard('min', 'low', 'x', _P['exit_period'])} AS exit_low,
         {_guard('avg', 'tr', 'a', _P['atr_period'])} AS atr,
         {_guard('avg', 'volume', 'v', _P['vol_period'])} AS vol_ma,
         {_guard('avg', 'log_volume', 'v', _P['vol_period'])} AS log_mean,
         {_guard('stddev_pop', 'log_volume', 'v', _P['vol_period'])} AS log_std,
         {_guard('avg', 'close', 'm', _P['ma_period'])} AS ma,
         {_guard('sum', 'taker_buy_base', 'v', _P['vol_period'])} AS taker_sum,
         {_guard('sum', 'volume', 'v', _P['vol_period'])} AS volume_sum
  FROM ranged WINDOW {_frame('e', _P['entry_period'])}, {_frame('x', _P['exit_period'])},
    {_frame('a', _P['atr_period'])}, {_frame('v', _P['vol_period'])}, {_frame('m', _P['ma_period'])}),
ind AS (
  SELECT *, volume / nullif(vol_ma, 0) AS vol_ratio, (log_volume - log_mean) / nullif(log_std, 0) AS vol_zscore,
         CASE WHEN entry_high - entry_low > 0
              THEN least(greatest((close - entry_low) / (entry_high - entry_low), 0), 1) ELSE 0.5 END AS channel_pos,
         taker_sum / nullif(volume_sum, 0) AS taker_buy_ratio,
         CASE WHEN count(atr / close) OVER d = {_P['daily_bars']} THEN avg(atr / close) OVER d END AS atr_daily
  FROM rolled WINDOW {_frame('d', _P['daily_bars'], True)})
"""

EVENT_IND = ctes(event_bars_sql(), INDICATORS_SQL)
DAILY_IND = ctes(DAILY_BARS_SQL, INDICATORS_SQL)


def event_indicators(spark, sf) -> DataFrame:
    return add_indicators(event_bars(spark, sf), **PERIODS)


def daily_indicators(spark, sf) -> DataFrame:
    return add_indicators(daily_bars(spark, sf), **PERIODS)


def _indicator_query(name: str, columns: str, daily: bool = False, exact: str = "") -> None:
    """``exact`` columns come from whole numbers; they are compared to the last digit instead of rounded."""
    source = daily_indicators if daily else event_indicators
    whole = "".join(f", {c}" for c in exact.split())
    sql = (DAILY_IND if daily else EVENT_IND) + f"SELECT symbol, pos, {r6(columns)}{whole} FROM ind"

    def run(spark, sf):
        rows = source(spark, sf)
        near = [F.round(c, 6).alias(c) for c in columns.split()]
        return rows.select("symbol", "pos", *near, *exact.split())

    register(name, sql)(run)


_indicator_query("ind_channels", "entry_high entry_low exit_high exit_low")
_indicator_query("ind_atr", "tr atr")
_indicator_query("ind_volume", "vol_ma vol_ratio vol_zscore")
_indicator_query("ind_channel_pos", "channel_pos")
_indicator_query("ind_returns", "ret_5 ret_10 ret_30")
_indicator_query("ind_trend_ma", "ma")
_indicator_query("ind_daily_atr", "atr_daily")
_indicator_query("ind_taker", "taker_buy_ratio")
_indicator_query("ind_daily_bars", "entry_high exit_low vol_ma vol_zscore channel_pos ret_10 ma", daily=True,
                 exact="taker_buy_ratio")
