"""Places of rows in a sorted table, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.llm.columns import free_name, quoted
from sparkbars.session import cut

PARTITION_BITS = 33  # of a monotonically increasing id


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` dealt out by ranges of ``order``, NULL first, and sorted inside each partition.

    Equal rows are parted by the place they were read from, so no value is too frequent for a task.
    """
    tie = free_name(df, "tie")
    by = [F.col(quoted(c)).asc_nulls_first() for c in [*order, tie]]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    return tied.repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds the place, from 0, of each row among the rows of equal ``keys`` (NULL is a key) along ``order``.

    Rows are counted inside the range they were sorted into; only one row per key and range is ordered by key.
    """
    at, part, first, before = (free_name(df, n) for n in ("at", "part", "first", "before"))
    marked = cut(ranged(df, [*keys, *order]).withColumn(at, F.monotonically_increasing_id()))
    marked = marked.withColumn(part, F.shiftright(at, PARTITION_BITS))
    runs = marked.groupBy(part, *[F.col(quoted(k)) for k in keys]).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(quoted(k)).alias(f"run_{i}") for i, k in enumerate(keys)],
        F.col(part).alias("run_part"), first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
    )
    same = F.col(part) == F.col("run_part")
    for i, k in enumerate(keys):
        same = same & F.col(quoted(k)).eqNullSafe(F.col(f"run_{i}"))
    place = (F.col(at) - F.col(first) + F.col(before)).alias(out)
    return marked.join(runs, same).select(*[F.col(quoted(c)) for c in df.columns], place)
