"""What all stateful jobs share: the state store they need and a file-to-file run."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.session import scratch_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state and timers need the disk-backed store, which also takes state larger than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


BUCKETS = 512


def bucket_of(key: str) -> Column:
    """The group that holds the state of a key, beside that of many other keys.

    A group costs milliseconds however few its rows are, so a group per key takes hours for millions of keys.
    The number of buckets belongs to the checkpoint and must not change under it.
    """
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def arrays_of(fields: str) -> str:
    """State schema of a bucket: one array per field, an element per key."""
    return ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in fields.split(", ")))


def sorted_rows(
    frames: Iterable[pd.DataFrame], columns: Sequence[str], order: Sequence[str], ascending: Sequence[bool] | bool = True
) -> Iterator[tuple]:
    """Rows of one key in one trigger as tuples in order, NULL as None; only the named columns are held."""
    held = [f[[*columns]] for f in frames]
    both = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    both = both.sort_values(list(order), ascending=ascending, kind="stable")
    lists = [both[c].astype("object").where(both[c].notna(), None).tolist() for c in columns]
    return zip(*lists, strict=True)


def run_counted(stream: DataFrame, output_mode: str = "append") -> tuple[DataFrame, dict[str, int]]:
    """Run a stream over everything its source holds now; the table it wrote, and how many rows were dropped.

    ``triggers`` counts the micro-batches, ``late`` the rows behind the watermark, ``repeated`` those dropped as duplicates. Progress
    and output live in the shared folder, so a lost executor or a restart resumes from the last finished batch.
    """
    spark = stream.sparkSession
    base = f"{scratch_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    steps = query.recentProgress
    operators = [o for p in steps for o in p["stateOperators"]]
    counts = {
        "triggers": sum(p["numInputRows"] > 0 for p in steps),
        "late": sum(o["numRowsDroppedByWatermark"] for o in operators),
        "repeated": sum(o["customMetrics"].get("numDroppedDuplicateRows", 0) for o in operators),
    }
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), counts


def run_available(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Run a stream over everything its source holds now and read the result back as a table."""
    return run_counted(stream, output_mode)[0]


ROWS_PER_TRIGGER = 1 << 20


def replay_of(table: DataFrame, order: Sequence[str], rows: int = ROWS_PER_TRIGGER) -> DataFrame:
    """A table as a file stream in the order of ``order``, of at most ``rows`` rows per trigger.

    It is written in ranges of that order, cut into files of that size. The file source goes by the time of a file, so the files
    get times in the order of their names.
    """
    spark = table.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    by = [F.col(c) for c in order]
    table.repartitionByRange(*by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", rows).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f.getPath().toString() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    newest = max((system.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f)).getModificationTime() for f in files), default=0)
    for place, name in enumerate(files):
        system.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), newest - 1000 * (len(files) - place), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_of(table: DataFrame) -> DataFrame:
    """A written table (see ``cut``) as a file stream, also one that is partitioned into folders."""
    folders = table.inputFiles()[0].split("/")[:-1]
    while "=" in folders[-1]:
        folders.pop()
    path = "/".join(folders)
    return table.sparkSession.readStream.schema(table.schema).parquet(path)
