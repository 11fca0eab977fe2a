"""Fixed schemas and column lists of the bar data model."""

from pyspark.sql import types as T

# Column names and order of the exchange's kline files.
RAW_KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "trades_count", "taker_buy_base", "taker_buy_quote", "ignore",
]
CSV_COLUMNS = RAW_KLINE_COLUMNS[:-1]
DOUBLE_COLUMNS = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote"]
LONG_COLUMNS = ["open_time", "close_time", "trades_count"]
REQUIRED_PRICE_COLUMNS = ["open", "high", "low", "close"]
LEDGER_COLUMNS = [
    "timestamp_ms", "symbol", "side", "quantity", "price", "fee", "pnl",
    "balance_after", "position_after", "reason",
]

# Columns of a dataset that are not model features.
NON_FEATURE_COLUMNS = [
    "label", "barrier_hit", "exit_idx", "n_bars_held", "entry_price", "exit_price", "actual_return",
    "return_atr", "raw_return", "y_norm", "truncated", "event_time", "side",
]
# First columns of a dataset, in order.
DATASET_META_COLUMNS = [
    "event_time", "side", "entry_price", "label", "barrier_hit", "exit_idx", "n_bars_held",
    "exit_price", "actual_return", "return_atr", "truncated",
]

KLINE_CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in LONG_COLUMNS else T.DoubleType()) for c in CSV_COLUMNS]
)

# Fields of one bar as a record on a message feed; prices arrive as numbers.
BAR_RECORD_SCHEMA = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.LongType() if c in LONG_COLUMNS else T.DoubleType()) for c in CSV_COLUMNS]
    + [T.StructField("is_closed", T.BooleanType())]
)


def require_columns(columns, required, what="input"):
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}")
