"""Bar tables derived from the driver's tables, as DataFrames and as SQL.

Tick prices of ``events`` are a running sum of signed values, kept in whole cents so
that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.operators.running import Running, running
from sparkbars.session import prepare
from sparkbars.sources.bars import DAY_MS, add_position, bar_times, bars_from_ticks, epoch_ms

BASE_CENTS = 10_000_000
TEN_MINUTES = 600_000
HOUR = 3_600_000

# Periods of the registered queries; a day holds 144 ten-minute bars.
PERIODS = dict(entry_period=20, exit_period=10, atr_period=20, vol_period=20, ma_period=200, daily_bars=144)
BARS_PER_YEAR = 365 * 144


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, width_ms: int = TEN_MINUTES) -> DataFrame:
    """Bars per event type with position: symbol, pos, open_time, prices, volume, taker flow, count."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    cents = F.round(F.col("value") * 100).cast("long")
    buys = F.col("user_id") % 2 == 0
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        ts.alias("us"),
        "event_id",
        (epoch_ms("ts") - F.pmod(epoch_ms("ts"), F.lit(width_ms))).alias("open_time"),
        cents.alias("cents"),
        F.when(buys, cents).otherwise(F.lit(0)).alias("taker_cents"),
        F.when(buys, cents).otherwise(-cents).alias("move"),
    )
    in_bar = W.partitionBy("symbol", "open_time").orderBy("us", "event_id")
    walked = ticks.select(
        "*",
        F.sum("move").over(in_bar.rowsBetween(W.unboundedPreceding, 0)).alias("rel"),
        F.row_number().over(in_bar).alias("rn"),
    )
    rel_bars = walked.groupBy("symbol", "open_time").agg(
        F.min_by("rel", "rn").alias("rel_open"),
        F.max("rel").alias("rel_high"),
        F.min("rel").alias("rel_low"),
        F.sum("move").alias("move"),
        F.sum("cents").alias("cents"),
        F.sum("taker_cents").alias("taker_cents"),
        F.count(F.lit(1)).alias("trades_count"),
    ).withColumn("_day", F.floor(F.col("open_time") / DAY_MS))
    # Day totals need no order inside the bar, so they come from a pre-aggregated second scan.
    day_totals = (
        ticks.groupBy("symbol", "open_time").agg(F.sum("move").alias("move"))
        .groupBy("symbol", F.floor(F.col("open_time") / DAY_MS).alias("_day"))
        .agg(F.sum("move").alias("end"), F.count(F.lit(1)).alias("rank"))
    )
    placed = running(
        rel_bars, ["symbol"], "_day", "open_time",
        [Running("end", "sum", F.col("move")), Running("rank", "sum", F.lit(1))],
        totals=day_totals,
    )
    start = F.col("end") - F.col("move") + BASE_CENTS
    dollars = lambda c: (c / 100).cast("double")
    return placed.select(
        "symbol",
        (F.col("rank") - 1).cast("long").alias("pos"),
        "open_time",
        dollars(start + F.col("rel_open")).alias("open"),
        dollars(start + F.col("rel_high")).alias("high"),
        dollars(start + F.col("rel_low")).alias("low"),
        dollars(F.col("end") + BASE_CENTS).alias("close"),
        dollars(F.col("cents")).alias("volume"),
        dollars(F.col("taker_cents")).alias("taker_buy_base"),
        "trades_count",
    )


EVENT_BARS_SQL = """
ticks AS (
  SELECT event_type AS symbol, epoch_us(ts) AS us, event_id,
         (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {width} AS open_time,
         CAST(round(value * 100) AS BIGINT) AS cents, user_id % 2 = 0 AS buys
  FROM events),
walk AS (
  SELECT *, 10000000 + CAST(sum(CASE WHEN buys THEN cents ELSE -cents END)
         OVER (PARTITION BY symbol ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS px
  FROM ticks),
raw_bars AS (
  SELECT symbol, open_time,
         CAST(arg_min(px, (us, event_id)) AS DOUBLE) / 100 AS open, CAST(max(px) AS DOUBLE) / 100 AS high,
         CAST(min(px) AS DOUBLE) / 100 AS low, CAST(arg_max(px, (us, event_id)) AS DOUBLE) / 100 AS close,
         CAST(sum(cents) AS DOUBLE) / 100 AS volume,
         CAST(sum(CASE WHEN buys THEN cents ELSE 0 END) AS DOUBLE) / 100 AS taker_buy_base,
         count(*) AS trades_count
  FROM walk GROUP BY symbol, open_time),
bars AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos, * EXCLUDE (symbol)
  FROM raw_bars)
"""


def event_bars_sql(width_ms: int = TEN_MINUTES) -> str:
    return EVENT_BARS_SQL.format(width=width_ms).strip()


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag from order lines, with position."""
    lines = table(spark, sf_dir, "lineitem")
    symbol, ts = F.col("l_returnflag"), epoch_ms("l_shipdate")
    bars = bars_from_ticks(
        lines,
        symbol,
        ts,
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.col("l_quantity"),
        F.col("l_linestatus") == "O",
        [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        DAY_MS,
    )
    return add_position(bars, times=bar_times(lines, symbol, ts, DAY_MS))


DAILY_BARS_SQL = """
prints AS (
  SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 86400000 AS open_time,
         l_extendedprice / l_quantity AS price, l_quantity AS qty, l_linestatus = 'O' AS taker,
         (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord
  FROM lineitem),
raw_bars AS (
  SELECT symbol, open_time, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ord) AS close, sum(qty) AS volume,
         sum(CASE WHEN taker THEN qty ELSE 0 END) AS taker_buy_base, count(*) AS trades_count
  FROM prints GROUP BY symbol, open_time),
bars AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos, * EXCLUDE (symbol)
  FROM raw_bars)
""".strip()
