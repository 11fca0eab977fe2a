"""Ingest of bar tables: files, raw klines, increments, messages, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.operators.running import row_index
from sparkbars.schema import (
    BAR_RECORD_SCHEMA,
    CSV_COLUMNS,
    DOUBLE_COLUMNS,
    KLINE_CSV_SCHEMA,
    LONG_COLUMNS,
    RAW_KLINE_COLUMNS,
    require_columns,
)

MINUTE_MS = 60_000
DAY_MS = 86_400_000


def no_nan(column: str | Column) -> Column:
    """Missing is NULL throughout: NaN from a file becomes NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def epoch_ms(ts: str | Column) -> Column:
    """Epoch milliseconds of a timestamp (UTC session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000)


def datetime_of(ms: str | Column) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_millis(c).cast("timestamp_ntz")


def _typed_csv(raw: DataFrame) -> DataFrame:
    """Columns by the names of the header; text that is no number becomes NULL, ``symbol`` stays if there."""
    kinds = {f.name: f.dataType for f in KLINE_CSV_SCHEMA.fields}
    require_columns(raw.columns, ["open_time", "open", "high", "low", "close"], "bar file")
    found = {c: F.col(c) if c in raw.columns else F.lit(None) for c in kinds}
    return raw.select(*[c for c in raw.columns if c == "symbol"], *[found[c].try_cast(k).alias(c) for c, k in kinds.items()])


def load_bars(spark: SparkSession, source: str, date_range: Sequence[str] | None = None) -> DataFrame:
    """Bars from a ``.parquet`` or ``.csv`` path, optionally cut to ``[start, end)``."""
    if source.endswith(".parquet"):
        # Files of other tools may keep nanosecond clocks, which arrive as whole numbers.
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        bars = spark.read.parquet(source)
    elif source.endswith(".csv"):
        bars = _typed_csv(spark.read.option("header", True).csv(source))
    else:
        raise ValueError(f"bar source must end in .parquet or .csv: {source}")
    bars = bars.withColumns({f.name: no_nan(f.name) for f in bars.schema if isinstance(f.dataType, T.DoubleType)})
    bars = date_filter(bars, *date_range) if date_range else bars
    if dict(bars.dtypes).get("datetime") == "bigint":
        bars = bars.withColumn("datetime", F.timestamp_micros(F.expr("datetime div 1000")).cast("timestamp_ntz"))
    return bars


def date_filter(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open date filter on ``datetime``, else on ``open_time``; both reach the Parquet scan."""
    if "datetime" in bars.columns:
        kind = bars.schema["datetime"].dataType
        if isinstance(kind, T.LongType):
            lo, hi = (epoch_ms(F.lit(x).cast("timestamp")) * 1_000_000 for x in (start, end))
        else:
            lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
        return bars.filter((F.col("datetime") >= lo) & (F.col("datetime") < hi))
    lo, hi = (epoch_ms(F.lit(x).cast("timestamp")) for x in (start, end))
    return bars.filter((F.col("open_time") >= lo) & (F.col("open_time") < hi))


def normalize_klines(raw: DataFrame) -> DataFrame:
    """Raw kline file to typed bars: positional names, bad text to NULL, rows without a key dropped.

    A frame of 12 or more columns is renamed by position; ``symbol`` is kept when present.
    """
    tail = [c for c in raw.columns if c in ("symbol", "batch_seq")]
    body = [c for c in raw.columns if c not in tail]
    if len(body) >= len(RAW_KLINE_COLUMNS):
        body = body[: len(RAW_KLINE_COLUMNS)]
        names = dict(zip(body, RAW_KLINE_COLUMNS, strict=True))
    else:
        names = {c: c for c in body}
    columns = []
    for old, new in names.items():
        if new == "ignore":
            continue
        c = F.col(f"`{old}`")
        if new in DOUBLE_COLUMNS:
            c = no_nan(c.try_cast("double"))
        elif new in LONG_COLUMNS:
            c = c.try_cast("double").try_cast("long")
        columns.append(c.alias(new))
    return raw.select(*tail, *columns).na.drop(subset=["open_time"])


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: the last along ``order``, or the first; reduced before the shuffle."""
    pick = F.min_by if first else F.max_by
    best = pick(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best).select("_row.*")


def merge_increments(*batches: DataFrame, keys: Sequence[str] = ("symbol", "open_time")) -> DataFrame:
    """Union of batches, oldest first, keeping the row of the newest batch per key, with ``datetime``.

    A batch may carry ``batch_seq`` itself; otherwise its place in the call counts. Inside
    a batch the highest ``row_seq`` is kept where there is one; rows that are equal in both are
    told apart by their values, so the result never depends on the order of input.
    """
    stamped = [
        b if "batch_seq" in b.columns else b.withColumn("batch_seq", F.lit(i).cast("long"))
        for i, b in enumerate(batches)
    ]
    merged = stamped[0].drop("datetime")
    for b in stamped[1:]:
        merged = merged.unionByName(b.drop("datetime"), allowMissingColumns=True)
    rest = [c for c in merged.columns if c not in ("batch_seq", "row_seq")]
    order = ["batch_seq", *[c for c in ("row_seq",) if c in merged.columns], *rest]
    kept = latest_per_key(merged, keys, order).drop("batch_seq", "row_seq")
    return kept.withColumn("datetime", datetime_of(keys[-1]))


def resume_increment(existing: DataFrame, incoming: DataFrame, step_ms: int = MINUTE_MS) -> DataFrame:
    """Incoming bars from one step after the newest stored bar of their symbol; all of a new symbol."""
    marks = existing.groupBy("symbol").agg((F.max("open_time") + step_ms).alias("_resume"))
    return (
        incoming.join(marks, "symbol", "left")
        .filter(F.col("_resume").isNull() | (F.col("open_time") >= F.col("_resume")))
        .drop("_resume")
    )


def normalize_funding(raw: DataFrame) -> DataFrame:
    """Funding rates as (datetime, calc_time, funding_rate); older files are read by position."""
    if "calc_time" in raw.columns:
        time_col = "calc_time"
        rate_col = "last_funding_rate" if "last_funding_rate" in raw.columns else "funding_rate"
    else:
        time_col, rate_col = raw.columns[0], raw.columns[1]
    out = raw.select(
        F.col(f"`{time_col}`").try_cast("double").try_cast("long").alias("calc_time"),
        no_nan(F.col(f"`{rate_col}`").try_cast("double")).alias("funding_rate"),
    ).na.drop()
    return out.select(datetime_of("calc_time").alias("datetime"), "calc_time", "funding_rate")


def merge_funding(*batches: DataFrame) -> DataFrame:
    """Funding batches, oldest first, one row per ``calc_time`` with the newest batch winning."""
    return merge_increments(*batches, keys=["calc_time"]).select("datetime", "calc_time", "funding_rate")


def add_position(
    bars: DataFrame, keys: Sequence[str] = ("symbol",), times: DataFrame | None = None
) -> DataFrame:
    """Dense position from 0 per symbol along ``open_time``; gaps in time are not filled.

    ``times`` may bring the keys and open times of the bars from a cheaper source than ``bars``.
    """
    day = F.expr(f"open_time div {DAY_MS}")
    counted = None if times is None else times.withColumn("_day", day)
    dayed = bars.withColumn("_day", day)
    return row_index(dayed, keys, "_day", ["open_time"], "pos", counted).drop("_day")


def bar_times(ticks: DataFrame, symbol: Column, ts_ms: Column, width_ms: int) -> DataFrame:
    """Symbol and open time of every bar of ``bars_from_ticks``, without building the bars."""
    start = (ts_ms - F.pmod(ts_ms, F.lit(width_ms))).alias("open_time")
    return ticks.select(symbol.alias("symbol"), start).distinct()


def bars_from_ticks(
    ticks: DataFrame,
    symbol: Column,
    ts_ms: Column,
    price: Column,
    qty: Column,
    taker: Column,
    order_keys: Sequence[Column],
    width_ms: int,
) -> DataFrame:
    """Bars of ``width_ms`` from prints; ``order_keys`` settle the order of prints.

    Every aggregate has a partial form, so ticks are reduced before the shuffle.
    """
    t = ticks.select(
        symbol.alias("symbol"),
        (ts_ms - F.pmod(ts_ms, F.lit(width_ms))).alias("open_time"),
        price.alias("price"),
        qty.alias("qty"),
        F.when(taker, qty).otherwise(F.lit(0.0)).alias("taker_qty"),
        F.struct(*order_keys).alias("ord"),
    )
    return t.groupBy("symbol", "open_time").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("taker_qty").alias("taker_buy_base"),
        F.count(F.lit(1)).alias("trades_count"),
    )


def bars_from_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Bars from exchange kline messages ``{s, k: {...}}``, whose prices are strings."""
    # JSON field names differ only by case here, so they must be matched exactly.
    m = messages.select(F.from_json(F.get_json_object(value, "$.k"), "map<string,string>").alias("k"),
                        F.get_json_object(value, "$.s").alias("symbol"))
    # Field letters of the exchange's kline message.
    doubles = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v",
               "quote_volume": "q", "taker_buy_base": "V", "taker_buy_quote": "Q"}
    longs = {"open_time": "t", "close_time": "T", "trades_count": "n"}
    picked = {name: m["k"][letter].try_cast("double") for name, letter in doubles.items()}
    picked |= {name: m["k"][letter].try_cast("long") for name, letter in longs.items()}
    return m.select(
        "symbol",
        *[picked[c].alias(c) for c in CSV_COLUMNS],
        m["k"]["x"].try_cast("boolean").alias("is_closed"),
    )


def bars_from_rest(rows: DataFrame, value: str = "value", symbol: str = "symbol") -> DataFrame:
    """Closed bars from JSON arrays in kline column order, numbers or numeric strings."""
    a = F.from_json(F.col(value), "array<string>")
    picked = []
    for i, name in enumerate(CSV_COLUMNS):
        kind = "long" if name in LONG_COLUMNS else "double"
        picked.append(F.get(a, F.lit(i)).try_cast(kind).alias(name))
    return rows.select(F.col(symbol).alias("symbol"), *picked, F.lit(True).alias("is_closed"))


def bar_records(messages: DataFrame, value: str = "value") -> DataFrame:
    """Bars from feed records, one JSON object per bar."""
    return messages.select(F.from_json(value, BAR_RECORD_SCHEMA).alias("r")).select("r.*")


def closed_bars(bars: DataFrame) -> DataFrame:
    return bars.filter("is_closed")


def csv_export_rows(bars: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """The 11 export columns, both bounds included, one row per ``open_time`` (and symbol if present)."""
    require_columns(bars.columns, CSV_COLUMNS, "bars for export")
    if start_ms is not None:
        bars = bars.filter(F.col("open_time") >= start_ms)
    if end_ms is not None:
        bars = bars.filter(F.col("open_time") <= end_ms)
    keys = (["symbol"] if "symbol" in bars.columns else []) + ["open_time"]
    # Full column order makes the surviving duplicate the same one in every run.
    order = [c for c in CSV_COLUMNS if c != "open_time"]
    return latest_per_key(bars.select(*{*keys, *CSV_COLUMNS}), keys, order, first=True).select(*keys[:-1], *CSV_COLUMNS)
