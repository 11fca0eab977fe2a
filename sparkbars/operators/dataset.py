"""Training datasets: events, features and labels on one row per event."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.features import Feature, compute_features, feature_names
from sparkbars.operators.labels import Labeler, event_rows
from sparkbars.operators.ranks import quantiles
from sparkbars.schema import DATASET_META_COLUMNS, NON_FEATURE_COLUMNS, REQUIRED_PRICE_COLUMNS, require_columns


def align_events(bars: DataFrame, events: DataFrame, signal: str = "signal") -> DataFrame:
    """Bars with the sparse event series as a dense column, 0 where there is no event."""
    side = events.select("symbol", "pos", F.col("side").alias(signal))
    return bars.join(side, ["symbol", "pos"], "left").withColumn(signal, F.coalesce(signal, F.lit(0)))


def build_dataset(
    bars: DataFrame, signal: Column, features: Feature, labeler: Labeler, boolean: bool = False
) -> DataFrame:
    """One row per event: time, side, labels, then features, keyed by (symbol, pos).

    ``bars`` is an indicator table and is read by several branches, so pass a written
    (or cut) one. Without events the result is empty with the same columns.
    """
    require_columns(bars.columns, REQUIRED_PRICE_COLUMNS, "bars")
    events = event_rows(bars, signal, boolean)
    time = "datetime" if "datetime" in bars.columns else "open_time"
    left = events.select(
        "symbol", "pos", F.col(time).alias("event_time"), "side",
        *[c.alias(f"_f_{n}") for n, c in features(events).items()],
    )
    joined = left.join(labeler(bars, events), ["symbol", "pos"], "left")
    names = feature_names(features, events)
    extra = [c for c in ("y_norm", "raw_return") if c in joined.columns]
    return joined.select(
        "symbol", "pos", *DATASET_META_COLUMNS, *[F.col(f"_f_{n}").alias(n) for n in names], *extra
    )


def features_with_labels(
    bars: DataFrame, signal: Column, features: Feature, labeler: Labeler, boolean: bool = False
) -> DataFrame:
    """The plain form: features of the events, left-joined with their labels."""
    events = event_rows(bars, signal, boolean)
    return compute_features(events, features).join(labeler(bars, events), ["symbol", "pos"], "left")


def dataset_meta(dataset: DataFrame, bars: DataFrame, config: Mapping | None = None) -> DataFrame:
    """One summary row; for no events every count is 0 and the maps are empty.

    The maps hold every label and barrier that occurs, in order. ``feature_names`` are the features in dataset order, ``config``
    is the configuration that made the dataset, as JSON, NULL where none is given.
    """
    names = [c for c in dataset.columns if c not in NON_FEATURE_COLUMNS and c not in ("symbol", "pos")]
    described = None if config is None else json.dumps(config, default=str, sort_keys=True)
    n = F.count(F.lit(1))
    stats = dataset.agg(
        n.alias("n_events"),
        F.count("label").alias("n_events_labeled"),
        F.count_if(F.col("truncated")).alias("n_truncated"),
        F.avg("actual_return").alias("mean_actual_return"),
        F.avg("n_bars_held").alias("mean_n_bars_held"),
    )
    n_bars = bars.agg(F.count(F.lit(1)).alias("n")).scalar()
    median = quantiles(dataset, "actual_return", [0.5]).select(F.get("q", F.lit(0))).scalar()

    def seen(column: str) -> Column:
        # one row per value that occurs, counted before anything is put together
        found = dataset.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(n.alias("v"))
        return found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).scalar()

    counts, barriers = seen("label"), seen("barrier_hit")
    rates = F.transform_values(F.col("_labels"), lambda k, v: F.try_divide(v.cast("double"), F.col("n_events")))
    return stats.withColumn("_labels", counts).select(
        "n_events", "n_events_labeled", "n_truncated",
        F.try_divide("n_events", n_bars).alias("coverage"),
        F.col("_labels").alias("label_counts"),
        rates.alias("label_rates"),
        barriers.alias("barrier_hit_counts"),
        "mean_actual_return",
        median.alias("median_actual_return"),
        "mean_n_bars_held",
        F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("feature_names"),
        F.lit(described).cast("string").alias("config"),
    )


def period_stats(dataset: DataFrame) -> DataFrame:
    """Per calendar year: events, share of positive y_norm, mean and median y_norm, mean raw return."""
    time = F.col("event_time")
    if dict(dataset.dtypes)["event_time"] == "bigint":
        time = F.timestamp_millis(time)
    yearly = dataset.withColumn("year", F.year(time))
    stats = yearly.groupBy("year").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg(F.when(F.col("y_norm") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("y_norm").alias("avg_y_norm"),
        F.avg("raw_return").alias("avg_raw_return"),
    )
    medians = quantiles(yearly, "y_norm", [0.5], ["year"]).select("year", F.get("q", F.lit(0)).alias("median_y_norm"))
    return stats.join(medians, "year", "left").select(
        "year", "events", "win_rate", "avg_y_norm", "median_y_norm", "avg_raw_return"
    )
