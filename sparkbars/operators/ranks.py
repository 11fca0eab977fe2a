"""Exact ranks and quantiles of large columns.

Values are first reduced to one row per distinct value, so a value shared by a third
of all rows is one row. Those rows are dealt into value ranges and their counts are
summed in two levels; no task sees a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.operators.running import Running, running
from sparkbars.session import cut


def value_counts(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None, **weights: Column
) -> DataFrame:
    """One row per (keys, value) with ``n`` and the summed ``weights``, each also accumulated up to the value.

    ``weight`` names a column of row counts when ``df`` is already grouped.

    Adds ``cum_<name>`` (inclusive) per counted column. NULL values are left out.
    """
    sums = {"n": F.sum(weight) if weight else F.count(F.lit(1)), **{k: F.sum(v) for k, v in weights.items()}}
    distinct = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(k) for k, c in sums.items()])
    )
    # The range number must be the same for every reader, so it is written down once.
    dealt = cut(distinct.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    items = [Running(f"cum_{k}", "sum", F.col(k)) for k in sums]
    by = list(keys) or ["_all"]
    if not keys:
        dealt = dealt.withColumn("_all", F.lit(0))
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(k).alias(f"cum_{k}") for k in sums])
    return running(dealt, by, "_range", value, items, totals=totals).drop("_range", "_all")


def average_rank() -> Column:
    """Rank of a value in ``value_counts`` output, ties sharing their mean rank (from 1)."""
    return F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key with an array ``q``.

    Without keys there is one row, NULL entries when no value exists.
    """
    counted = value_counts(df, value, keys)
    if keys:
        counted = counted.join(counted.groupBy(*keys).agg(F.max("cum_n").alias("_total")), list(keys))
    else:
        counted = counted.withColumn("_total", counted.agg(F.max("cum_n").alias("t")).scalar())
    start, end = F.col("cum_n") - F.col("n"), F.col("cum_n")
    total = F.col("_total")

    def at(index: Column) -> Column:
        return F.max(F.when((start <= index) & (index < end), F.col(value)))

    picks = []
    for i, p in enumerate(probs):
        h = (total - 1) * F.lit(float(p))
        picks += [
            at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
    found = counted.groupBy(*keys).agg(*picks)
    edges = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(probs))
    ]
    return found.select(*keys, F.array(*edges).alias("q"))
