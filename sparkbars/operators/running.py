"""Running aggregates over a long ordered history, without one task per key.

A running sum, maximum or last value over a whole key is split in two levels:
inside a chunk of the key by a window keyed by ``(key, chunk)``, and across chunks
by a window over one row per chunk. Only the small chunk table is ordered per key,
so a key holding a third of all rows is still spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.session import cut

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """``how`` is sum, max, min or last (the latest value that is not NULL)."""

    out: str
    how: str
    value: Column


def _total(item: Running, order: Column, reverse: bool) -> Column:
    if item.how == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(item.value, F.when(item.value.isNotNull(), order))
    return _FOLD[item.how](item.value)


def _over(item_how: str, value: Column, window) -> Column:
    if item_how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _FOLD[item_how](value).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    items: Sequence[Running],
    reverse: bool = False,
    totals: DataFrame | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add one running aggregate per item, the current row included unless ``exclusive``.

    ``chunk`` is a column that never decreases along ``order`` within a key, and
    ``order`` has no ties there. ``totals`` may bring the per-chunk totals (keys,
    chunk, one column per item, same names) when a cheaper source than ``df`` exists.
    """
    keys = list(keys)
    direction = (lambda c: F.col(c).desc()) if reverse else F.col
    if totals is None:
        totals = df.groupBy(*keys, chunk).agg(*[_total(i, F.col(order), reverse).alias(i.out) for i in items])
    across = W.partitionBy(*keys).orderBy(direction(chunk)).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(chunk).alias("_k_chunk"),
        *[_over(i.how, F.col(i.out), across).alias(f"_carry_{i.out}") for i in items],
    )
    inside = W.partitionBy(*keys, chunk).orderBy(direction(order)).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0
    )
    inner = df.select("*", *[_over(i.how, i.value, inside).alias(f"_in_{i.out}") for i in items])
    on = F.col(chunk) == F.col("_k_chunk")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    joined = inner.join(carry, on, "left")
    outs = []
    for i in items:
        here, before = F.col(f"_in_{i.out}"), F.col(f"_carry_{i.out}")
        if i.how == "sum":
            both = F.coalesce(here + before, here, before)
        elif i.how == "max":
            both = F.greatest(here, before)
        elif i.how == "min":
            both = F.least(here, before)
        else:
            both = F.coalesce(here, before)
        outs.append(both.alias(i.out))
    replaced = {i.out for i in items}
    return joined.select(*[c for c in df.columns if c not in replaced], *outs)


RANGE_BITS = 33  # of a monotonically increasing id: the row's place inside its range


def range_index(df: DataFrame, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Gap-free index from 0 over the whole table along ``order``, NULL first.

    Rows are dealt out by ranges of ``order`` and counted inside their range, so it does not matter how many share a
    time; only one row per range is ordered globally. Rows that are equal in ``order`` should not occur: which of
    them comes first is not defined.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    at = F.monotonically_increasing_id().alias("_at")
    sorted_ = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", at))
    part = F.shiftright("_at", RANGE_BITS)
    across = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = sorted_.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = ranges.select("_part", (F.coalesce(F.sum("_n").over(across), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = sorted_.join(offsets, part == F.col("_part"))
    return joined.select(*[c for c in df.columns if c != out], (F.col("_at") + F.col("_shift")).cast("long").alias(out))


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    out: str = "row_index",
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Gap-free index from 0 along ``order`` (unique within key and chunk), per key.

    ``keys`` may be empty for one index over the whole table; ``chunk`` then spreads
    the work, and only one row per chunk is ordered globally. ``sizes_from`` may hold the
    same rows from a cheaper source, for counting them.
    """
    keys = list(keys)
    sizes = (df if sizes_from is None else sizes_from).groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, chunk, F.coalesce(F.sum("_n").over(across), F.lit(0)).cast("long").alias("_offset")
    )
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, chunk])
        .withColumn(out, F.col("_offset") + F.col("_rn") - 1)
        .select(*[c for c in df.columns if c != out], out)
    )
