"""Ranking quality of a score: rank correlation, quantile staircase, AUC, time splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.operators.ranks import average_rank, quantiles, value_counts
from sparkbars.operators.running import range_index
from sparkbars.session import cut

# Acceptance limits of the evaluation.
IC_THRESHOLD = 0.03
P_THRESHOLD = 0.05
AUC_THRESHOLD = 0.55
MIN_IC_ROWS = 10
MIN_AUC_ROWS = 5


def _valid(df: DataFrame, score: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    s, t = F.col(score).cast("double"), F.col(target).cast("double")
    both = df.select(*keys, s.alias("score"), t.alias("target"))
    return both.filter(~F.isnan("score") & ~F.isnan("target") & F.col("score").isNotNull() & F.col("target").isNotNull())


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        value *= c * d
        if i and abs(c * d - 1.0) < 1e-15:
            break
    return front * (value - 1.0) / a


def correlation_p_value(ic: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    if not -1.0 < ic < 1.0:
        return 0.0
    dof = n - 2
    t2 = ic * ic * dof / ((1.0 + ic) * (1.0 - ic))
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t2))


@F.pandas_udf(T.DoubleType())
def _p_value(ic: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(r) else correlation_p_value(float(r), int(k)) for r, k in zip(ic, n)])


def rank_ic(
    df: DataFrame, score: str, target: str, threshold: float = IC_THRESHOLD, keys: Sequence[str] = ()
) -> DataFrame:
    """(n, ic, p_value, pass) per key: Spearman correlation, ties sharing their mean rank.

    Fewer than ten usable rows give (0, 1, false); without keys there is always one row.
    """
    keys = list(keys)
    pairs = cut(
        _valid(df, score, target, keys).groupBy(*keys, "score", "target").agg(F.count(F.lit(1)).alias("w"))
    )
    ranked = pairs
    for name in ("score", "target"):
        ranks = value_counts(pairs, name, keys, weight="w").select(*keys, name, average_rank().alias(f"_r_{name}"))
        ranked = ranked.join(ranks, [*keys, name])
    # Both ranks have mean (n + 1) / 2, so only n is needed to centre them, and the sums cannot cancel.
    if keys:
        ranked = ranked.join(pairs.groupBy(*keys).agg(F.sum("w").alias("_n")), keys)
    else:
        ranked = ranked.withColumn("_n", pairs.agg(F.sum("w").alias("n")).scalar())
    mean = (F.col("_n") + 1) / 2
    x, y, w = F.col("_r_score") - mean, F.col("_r_target") - mean, F.col("w")
    sums = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"),
    )
    enough = F.col("n") >= MIN_IC_ROWS
    measured = sums.select(
        *keys, "n", F.when(enough, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("_ic")
    ).withColumn("_p", _p_value("_ic", "n"))
    return measured.select(
        *keys, "n",
        F.when(enough, F.col("_ic")).otherwise(F.lit(0.0)).alias("ic"),
        F.when(enough, F.col("_p")).otherwise(F.lit(1.0)).alias("p_value"),
        F.coalesce(enough & (F.abs("_ic") > threshold) & (F.col("_p") < P_THRESHOLD), F.lit(False)).alias("pass"),
    )


def quantile_grid(n_quantiles: int) -> list[float]:
    """Evenly spaced probabilities as whole multiples of one step, ending at exactly 1."""
    return [i * (1.0 / n_quantiles) for i in range(n_quantiles)] + [1.0]


def quantile_staircase(df: DataFrame, score: str, target: str, n_quantiles: int = 5) -> DataFrame:
    """One row (quantile_means, spread, monotonic): mean target per score quantile.

    Edges interpolate linearly, bins are closed on the right, repeated edges merge and
    a bin without rows counts as 0. Too few rows give an empty list.
    """
    pairs = _valid(df, score, target)
    edges = quantiles(pairs, "score", quantile_grid(n_quantiles))
    cuts = edges.select(F.array_distinct("q").alias("q")).scalar()
    # Bin of a score: number of distinct inner edges below it; the lowest edge belongs to bin 0.
    binned = pairs.withColumn("_e", cuts).select(
        "target",
        F.greatest(F.size(F.filter("_e", lambda e: e < F.col("score"))) - 1, F.lit(0)).alias("bin"),
    )
    per_bin = binned.groupBy("bin").agg(F.sum("target").alias("s"), F.count(F.lit(1)).alias("c"))
    wide = per_bin.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        *[
            F.coalesce(F.max(F.when(F.col("bin") == i, F.col("s") / F.col("c"))), F.lit(0.0)).alias(f"_m{i}")
            for i in range(n_quantiles)
        ],
    )
    enough = F.col("n") >= n_quantiles * 5
    means = F.array(*[F.col(f"_m{i}") for i in range(n_quantiles)])
    rising = F.lit(True)
    for i in range(n_quantiles - 1):
        rising = rising & (F.col(f"_m{i}") <= F.col(f"_m{i + 1}"))
    return wide.select(
        F.when(enough, means).otherwise(F.array().cast("array<double>")).alias("quantile_means"),
        F.when(enough, F.col(f"_m{n_quantiles - 1}") - F.col("_m0")).otherwise(F.lit(0.0)).alias("spread"),
        (enough & rising).alias("monotonic"),
    )


def auc_roc(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row (auc, pass) of a 0/1 target; ties count half. One class or under five rows gives 0.5."""
    pairs = _valid(df, score, target)
    positive = (F.col("target") == 1).cast("long")
    counted = value_counts(pairs, "score", pos=positive, neg=1 - positive)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    sums = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.col("pos") * below).alias("u"),
    )
    usable = (F.col("n") >= MIN_AUC_ROWS) & (F.col("p") > 0) & (F.col("q") > 0)
    auc = F.when(usable, F.try_divide("u", F.col("p").cast("double") * F.col("q"))).otherwise(F.lit(0.5))
    return sums.select(auc.alias("auc"), (usable & (auc > AUC_THRESHOLD)).alias("pass"))


def time_index(dataset: DataFrame) -> DataFrame:
    """Rows numbered from 0 in time order (ties by symbol and position); rows of one time are spread like others."""
    return range_index(dataset, ["event_time", "symbol", "pos"])


def event_gap(dataset: DataFrame, horizon: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events to skip so that a label of ``horizon`` bars cannot reach from train into validation."""
    spread = F.try_divide(F.max("pos") - F.min("pos"), F.count(F.lit(1)) - 1)
    spacing = F.when(F.count(F.lit(1)) > 1, F.greatest(spread, F.lit(1.0))).otherwise(F.lit(1.0))
    return dataset.groupBy(*keys).agg(
        F.greatest(F.ceil(F.lit(float(horizon)) / spacing), F.lit(1)).cast("int").alias("gap")
    )


def purged_folds(indexed: DataFrame, n_splits: int = 5, gap: int | Column = 0) -> DataFrame:
    """Rows of ``time_index`` output per fold, ``role`` train or validation; a row can serve several folds.

    Training always expands from the first row and stops ``gap`` rows before validation.
    """
    n = indexed.agg(F.count(F.lit(1)).alias("n")).scalar()
    checked = F.when(n >= 2 * n_splits, n).otherwise(
        F.raise_error(F.lit(f"not enough rows for {n_splits} splits")).cast("long")
    )
    gap = F.lit(gap) if isinstance(gap, int) else gap
    sized = indexed.withColumn("_size", F.floor(checked / (n_splits + 1)))
    size, i = F.col("_size"), F.col("row_index")
    safe_gap = F.least(gap, F.greatest(size - 1, F.lit(0)))
    fold = F.col("fold")
    start = (fold + 1) * size
    train_end = F.greatest(size, start - safe_gap)
    role = F.when(i < train_end, "train").when((i >= start) & (i < start + size), "validation")
    return (
        sized.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .drop("_size")
    )


def chronological_split(indexed: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Rows of ``time_index`` output with ``role`` train (the first share) or test."""
    n = indexed.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = F.floor(n * F.lit(float(train_share)))
    return indexed.withColumn("role", F.when(F.col("row_index") < at, "train").otherwise("test"))


def cv_summary(fold_ics: DataFrame, threshold: float = IC_THRESHOLD) -> DataFrame:
    """Mean, sample deviation (0 for a single fold) and verdict of per-fold ``ic`` values."""
    return fold_ics.agg(
        F.avg("ic").alias("mean_ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("std_ic"),
        (F.abs(F.avg("ic")) > threshold).alias("pass"),
    )
