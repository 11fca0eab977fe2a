"""Evaluation of scores and boosted-tree models."""

from pyspark.sql import functions as F

from sparkbars.catalog.event_queries import DATASET_SQL, HORIZON, fixed_dataset
from sparkbars.catalog.inputs import event_bars
from sparkbars.catalog.registry import register, rounded
from sparkbars.catalog.trade_queries import OPTIONS
from sparkbars.functions import features as X
from sparkbars.operators import evaluate as V
from sparkbars.operators import model as M
from sparkbars.operators.trades import Run
from sparkbars.plans.sweep import backtest, finite_profit_factor
from sparkbars.session import cut

SCORE, TARGET = "vol_zscore", "y_norm"
QUANTILES = 5
FOLDS = 5
TREES = dict(maxIter=8, maxDepth=3)


def _average_rank(column: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    both = f"PARTITION BY {partition + ', ' if partition else ''}{column}"
    return f"rank() OVER ({by}ORDER BY {column}) + (count(*) OVER ({both}) - 1) / 2"


@register(
    "rank_ic",
    DATASET_SQL + f"""SELECT count(*) AS n, round(corr(rs, rt), 6) + 0.0 AS ic FROM (
      SELECT {_average_rank(SCORE)} AS rs, {_average_rank(TARGET)} AS rt FROM dataset)""",
)
def rank_ic(spark, sf):
    return rounded(V.rank_ic(fixed_dataset(spark, sf), SCORE, TARGET).select("n", "ic"))


@register(
    "rank_ic_ties",
    DATASET_SQL + f"""SELECT symbol, count(*) AS n, round(corr(rs, rt), 6) + 0.0 AS ic FROM (
      SELECT symbol, {_average_rank('s', 'symbol')} AS rs, {_average_rank(TARGET, 'symbol')} AS rt
      FROM (SELECT *, round(taker_buy_ratio, 1) AS s FROM dataset)) GROUP BY symbol""",
)
def rank_ic_ties(spark, sf):
    data = fixed_dataset(spark, sf).withColumn("s", F.round("taker_buy_ratio", 1))
    return rounded(V.rank_ic(data, "s", TARGET, keys=["symbol"]).select("symbol", "n", "ic"))


_GRID = ", ".join(f"{p!r}" for p in V.quantile_grid(QUANTILES))


@register(
    "quantile_staircase",
    DATASET_SQL.rstrip() + f""",
edges AS (SELECT list_distinct(quantile_cont({SCORE}, [{_GRID}])) AS q FROM dataset),
bins AS (SELECT greatest(len(list_filter(q, lambda e: e < {SCORE})) - 1, 0) AS bin, {TARGET} AS t FROM dataset, edges),
means AS (SELECT bin, avg(t) AS m FROM bins GROUP BY bin),
wide AS (SELECT {", ".join(f"coalesce(max(m) FILTER (bin = {i}), 0) AS m{i}" for i in range(QUANTILES))} FROM means)
SELECT {", ".join(f"round(m{i}, 6) + 0.0 AS m{i}" for i in range(QUANTILES))}, round(m{QUANTILES - 1} - m0, 6) + 0.0 AS spread,
  {" AND ".join(f"m{i} <= m{i + 1}" for i in range(QUANTILES - 1))} AS monotonic FROM wide""",
)
def quantile_staircase(spark, sf):
    out = V.quantile_staircase(cut(fixed_dataset(spark, sf)), SCORE, TARGET, QUANTILES)
    return rounded(out.select(
        *[F.get("quantile_means", F.lit(i)).alias(f"m{i}") for i in range(QUANTILES)], "spread", "monotonic"
    ))


@register(
    "auc",
    DATASET_SQL + f"""SELECT round(auc, 6) AS auc, auc > 0.55 AS pass FROM (
      SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
             / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS auc
      FROM (SELECT {_average_rank('s')} AS r, y FROM (
        SELECT round({SCORE}, 1) AS s, CASE WHEN {TARGET} > 0 THEN 1 ELSE 0 END AS y FROM dataset)))""",
)
def auc(spark, sf):
    data = fixed_dataset(spark, sf).select(
        F.round(SCORE, 1).alias("s"), F.when(F.col(TARGET) > 0, 1).otherwise(0).alias("y")
    )
    return rounded(V.auc_roc(data, "s", "y"))


_INDEXED = DATASET_SQL.rstrip() + f""",
indexed AS (SELECT *, row_number() OVER (ORDER BY event_time, symbol, pos) - 1 AS row_index FROM dataset),
total AS (SELECT count(*) AS n, greatest(ceil({HORIZON} / greatest((max(pos) - min(pos)) / (count(*) - 1), 1)), 1) AS gap FROM dataset),
sizes AS (SELECT n // {FOLDS + 1} AS size, least(gap, greatest(n // {FOLDS + 1} - 1, 0)) AS gap FROM total),
folds AS (
  SELECT f.fold, i.*, CASE WHEN row_index < greatest(size, (f.fold + 1) * size - gap) THEN 'train'
       WHEN row_index >= (f.fold + 1) * size AND row_index < (f.fold + 2) * size THEN 'validation' END AS role
  FROM indexed i, sizes, (SELECT unnest(range({FOLDS})) AS fold) f)
"""


def _folds(spark, sf):
    data = cut(fixed_dataset(spark, sf))
    gap = V.event_gap(data, HORIZON).select("gap").scalar()
    return V.purged_folds(V.time_index(data), FOLDS, gap)


@register(
    "purged_folds",
    _INDEXED + "SELECT CAST(fold AS INTEGER) AS fold, role, symbol, pos, row_index FROM folds WHERE role IS NOT NULL",
)
def purged_folds(spark, sf):
    return _folds(spark, sf).select("fold", "role", "symbol", "pos", "row_index")


@register(
    "chrono_split",
    _INDEXED + """SELECT symbol, pos, row_index, CASE WHEN row_index < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role
    FROM indexed, total""",
)
def chrono_split(spark, sf):
    out = V.chronological_split(V.time_index(cut(fixed_dataset(spark, sf))), 0.8)
    return out.select("symbol", "pos", "row_index", "role")


@register(
    "cv_summary",
    _INDEXED.rstrip() + f""",
ics AS (SELECT fold, corr(rs, rt) AS ic FROM (
  SELECT fold, {_average_rank(SCORE, 'fold')} AS rs, {_average_rank(TARGET, 'fold')} AS rt FROM folds WHERE role = 'validation')
  GROUP BY fold)
SELECT round(avg(ic), 6) + 0.0 AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, abs(avg(ic)) > 0.03 AS pass FROM ics""",
)
def cv_summary(spark, sf):
    validation = _folds(spark, sf).filter("role = 'validation'")
    return rounded(V.cv_summary(V.rank_ic(validation, SCORE, TARGET, keys=["fold"])))


@register("gbt_scores")
def gbt_scores(spark, sf):
    split = cut(V.chronological_split(V.time_index(cut(fixed_dataset(spark, sf)))))
    model = M.train_regressor(split.filter("role = 'train'"), TARGET, **TREES)
    return M.score(model, split.filter("role = 'test'")).select("symbol", "pos", TARGET, "score")


@register("gbt_classifier")
def gbt_classifier(spark, sf):
    data = cut(fixed_dataset(spark, sf).withColumn("y", (F.col(TARGET) > 0).cast("double")))
    names = [c for c in M.feature_columns(data) if c != "y"]
    split = cut(V.chronological_split(V.time_index(data)))
    model = M.train_classifier(split.filter("role = 'train'"), "y", names, **TREES)
    return V.auc_roc(M.score(model, split.filter("role = 'test'")), "score", "y")


@register("gbt_cross_validation")
def gbt_cross_validation(spark, sf):
    return V.cv_summary(M.cross_validate(_folds(spark, sf), FOLDS, TARGET, maxIter=3, maxDepth=3))


ML_RUNS = [Run(0, 20, 10, 20, 2.0, 0.0), Run(1, 40, 20, 40, 2.0, 0.0)]


@register("backtest_ml_filtered")
def backtest_ml_filtered(spark, sf):
    """Learns from the first four fifths of the events and trades on the bars after them, each run by its own periods."""
    split = cut(V.chronological_split(V.time_index(cut(fixed_dataset(spark, sf)))))
    model = M.train_regressor(split.filter("role = 'train'"), TARGET, **TREES)
    start = split.filter("role = 'test'").agg(F.min("event_time")).first()[0]
    bars = event_bars(spark, sf)
    keep = M.keep_scored_by_run(model, cut(bars), ML_RUNS, X.default_feature_set(), from_time=start)
    done = backtest(bars, ML_RUNS, keep_entry=keep, **OPTIONS)
    return finite_profit_factor(done.metrics)
