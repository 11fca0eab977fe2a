"""Boosted trees on a dataset: training, saving, scoring, filtering entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.features import Feature, compute_features
from sparkbars.operators.evaluate import rank_ic
from sparkbars.operators.indicators import add_indicators
from sparkbars.operators.trades import Run
from sparkbars.schema import NON_FEATURE_COLUMNS
from sparkbars.session import cut

# Training parameters of the two models.
REGRESSOR_PARAMS = dict(maxIter=400, maxDepth=5, stepSize=0.03, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
CLASSIFIER_PARAMS = dict(maxIter=200, maxDepth=4, stepSize=0.05, seed=42)

# Names under which configurations state training parameters.
PUBLISHED_PARAMS = {
    "n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy", "random_state": "seed",
}


def spark_params(params: Mapping[str, object], estimator: type) -> dict:
    """Training parameters by Spark's names; an unknown one is refused by name."""
    out = {}
    for name, value in params.items():
        own = PUBLISHED_PARAMS.get(name, name)
        if not hasattr(estimator, own):
            raise ValueError(f"unknown training parameter {name!r}; known: {', '.join(PUBLISHED_PARAMS)} and Spark's own")
        out[own] = str(float(value)) if own == "featureSubsetStrategy" and not isinstance(value, str) else value
    return out


KEY_COLUMNS = ["symbol", "pos", "row_index", "fold", "role"]


def feature_columns(dataset: DataFrame, exclude: Sequence[str] = NON_FEATURE_COLUMNS) -> list[str]:
    """Every column that is neither a key nor a label, in dataset order."""
    return [c for c in dataset.columns if c not in exclude and c not in KEY_COLUMNS]


def model_input(dataset: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features as 0, the value the model was trained with."""
    return dataset.na.fill(0.0, list(features))


def train_regressor(
    dataset: DataFrame, target: str = "y_norm", features: Sequence[str] | None = None, **params
) -> PipelineModel:
    features = list(features or feature_columns(dataset))
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="score", **{**REGRESSOR_PARAMS, **spark_params(params, GBTRegressor)})
    return _fit(dataset, features, gbt, target)


def train_classifier(
    dataset: DataFrame, target: str, features: Sequence[str] | None = None, **params
) -> PipelineModel:
    """Classifier of a 0/1 column; its score is the probability of 1."""
    features = list(features or feature_columns(dataset))
    gbt = GBTClassifier(featuresCol="features", labelCol=target, **{**CLASSIFIER_PARAMS, **spark_params(params, GBTClassifier)})
    return _fit(dataset, features, gbt, target)


def _fit(dataset: DataFrame, features: list[str], estimator, target: str) -> PipelineModel:
    rows = model_input(dataset.select(*features, F.col(target).cast("double").alias(target)), features)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(rows.filter(F.col(target).isNotNull()))


def model_features(model: PipelineModel) -> list[str]:
    """Feature names in the order the model takes them; they are stored with the model."""
    return list(model.stages[0].getInputCols())


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``score``; batch or stream."""
    features = model_features(model)
    out = model.transform(model_input(rows, features))
    if "score" not in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def keep_scored(model: PipelineModel, bars: DataFrame, features: Feature, threshold: float = 0.0):
    """A candidate filter for backtests: entries whose score exceeds the threshold.

    ``bars`` is one indicator table for all runs. Only candidate bars are scored, each once, whatever the number of runs that
    enter there.
    """

    def keep(candidates: DataFrame) -> DataFrame:
        wanted = candidates.select("symbol", "pos").distinct()
        passed = _passed(model, bars, wanted, features, threshold)
        return candidates.join(passed.select("symbol", "pos"), ["symbol", "pos"], "left_semi").select(*candidates.columns)

    return keep


def _passed(model: PipelineModel, bars: DataFrame, wanted: DataFrame, features: Feature, threshold: float) -> DataFrame:
    at = bars.join(wanted, ["symbol", "pos"], "left_semi")
    return score(model, compute_features(at, features)).filter(F.col("score") > threshold)


def keep_scored_by_run(
    model: PipelineModel, bars: DataFrame, runs: Sequence[Run], features: Feature, threshold: float = 0.0,
    from_time: int | None = None, **indicators,
):
    """A candidate filter for backtests in which every run is judged by features of its own periods.

    Features and scores are kept by (period set, symbol, position): an indicator table per distinct set of
    entry, exit and range period, in which a bar is scored once for all runs of the set. ``indicators`` sets the other
    periods. Entries before ``from_time``, the end of what the model learned from, are not made.
    """
    sets = list(dict.fromkeys((r.entry_period, r.exit_period, r.atr_period) for r in runs))
    number = F.create_map(*[F.lit(x) for r in runs for x in (r.run_id, sets.index((r.entry_period, r.exit_period, r.atr_period)))])

    def keep(candidates: DataFrame) -> DataFrame:
        named = cut(candidates.withColumn("_set", F.try_element_at(number, F.col("run_id"))))
        passed = None
        for i, (entry, exit_, atr) in enumerate(sets):
            wanted = named.filter(F.col("_set") == i).select("symbol", "pos").distinct()
            table = add_indicators(bars, entry, exit_, atr, **indicators)
            table = table if from_time is None else table.filter(F.col("open_time") >= from_time)
            own = _passed(model, table, wanted, features, threshold).select(F.lit(i).alias("_set"), "symbol", "pos")
            passed = own if passed is None else passed.unionByName(own)
        return named.join(passed, ["_set", "symbol", "pos"], "left_semi").select(*candidates.columns)

    return keep


def cross_validate(
    folds: DataFrame, n_splits: int, target: str = "y_norm", features: Sequence[str] | None = None, **params
) -> DataFrame:
    """Rank IC of every fold of ``purged_folds``; one model per fold, so the loop is as long as the folds are many."""
    folds = cut(folds)
    features = list(features or feature_columns(folds))
    scored = None
    for i in range(n_splits):
        fold = folds.filter(F.col("fold") == i)
        model = train_regressor(fold.filter("role = 'train'"), target, features, **params)
        part = score(model, fold.filter("role = 'validation'")).select("fold", "score", target)
        scored = part if scored is None else scored.unionByName(part)
    return rank_ic(scored, "score", target, keys=["fold"])
