"""Writers for bars, datasets, sweep results and ledgers. Files are written by the executors, in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.schema import LEDGER_COLUMNS, require_columns
from sparkbars.session import cut
from sparkbars.sources.bars import csv_export_rows, merge_increments


def write_bars_csv(bars: DataFrame, path: str, start_ms: int | None = None, end_ms: int | None = None) -> None:
    """Bars for replay: header, 11 columns, sorted by time across and inside the part files."""
    rows = csv_export_rows(bars, start_ms, end_ms)
    order = [c for c in ("symbol", "open_time") if c in rows.columns]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def merge_into(path: str, *batches: DataFrame) -> None:
    """Merges increments, oldest first, into bars stored by symbol and month; other folders are not touched.

    ``path`` holds one folder per symbol and month (UTC). Only folders that a batch has rows of are read and written again, as a whole, by
    dynamic partition overwrite; a stored row counts as older than any batch. A path that does not exist is made.
    """
    spark = batches[0].sparkSession
    month = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM").alias("month")
    stamped = [b.withColumn("batch_seq", F.lit(i + 1).cast("long")) for i, b in enumerate(batches)]
    fresh = cut(merge_increments(*stamped).drop("datetime").select("*", month))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = fresh
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(fresh.schema).parquet(path)
        # one row per folder with news, which prunes the folders that are read
        touched = fresh.select("symbol", "month").distinct()
        old = stored.join(touched, ["symbol", "month"], "left_semi").withColumn("batch_seq", F.lit(0).cast("long"))
        both = merge_increments(old.drop("month"), fresh.drop("month").withColumn("batch_seq", F.lit(1).cast("long")))
        rows = cut(both.drop("datetime").select("*", month))  # written before its source is replaced
    sorted_ = rows.repartition("symbol", "month").sortWithinPartitions("symbol", "month", "open_time")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def write_dataset(dataset: DataFrame, path: str) -> None:
    """Dataset as Parquet, one folder per symbol; rows of a symbol are spread over several files by time."""
    spread = dataset.repartitionByRange("symbol", "pos").sortWithinPartitions("symbol", "pos")
    spread.write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_sweep(result: DataFrame, path: str) -> None:
    """Sweep result in the format its suffix names, Parquet or else CSV."""
    writer = result.write.mode("overwrite")
    if path.endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Ledger CSV in its ten columns, numbers to ten significant digits."""
    require_columns(ledger.columns, LEDGER_COLUMNS, "ledger")
    kinds = dict(ledger.dtypes)
    # Ten significant digits: as many decimals as the size of the number leaves.
    decimals = lambda c: 9 - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-300)))).cast("int")
    digits = lambda c: F.when(c == 0, c).otherwise(F.round(c * F.pow(F.lit(10.0), decimals(c))) / F.pow(F.lit(10.0), decimals(c)))
    order = [c for c in ("account", "seq") if c in ledger.columns] or ["timestamp_ms"]
    shown = [digits(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in LEDGER_COLUMNS]
    ledger.repartitionByRange(*order).sortWithinPartitions(*order).select(*shown).write.mode("overwrite").option(
        "header", True
    ).csv(path)
