"""The research run: bars to dataset to model to report, from one configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.operators import dataset as D
from sparkbars.operators import evaluate as V
from sparkbars.operators import model as M
from sparkbars.operators.indicators import add_indicators
from sparkbars.plans import components as C
from sparkbars.session import cut
from sparkbars.sources.bars import add_position, load_bars
from sparkbars.sources.sinks import write_dataset


@dataclass(frozen=True)
class Research:
    """Results of a run; metrics are small tables, the dataset stays distributed."""

    dataset: DataFrame
    meta: DataFrame
    yearly: DataFrame | None
    ic: DataFrame | None
    staircase: DataFrame | None
    model: PipelineModel | None
    test_yearly: DataFrame | None = None


def load_config(path: str) -> dict:
    """A YAML configuration file as a dict."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML configuration needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def config_dataset(spark: SparkSession, cfg: Mapping, range_key: str) -> tuple[DataFrame, DataFrame]:
    """(indicator bars, dataset) of one date range of the configuration."""
    data = cfg["data"]
    bars = load_bars(spark, data["source"], data.get(range_key))
    if "symbol" not in bars.columns:
        bars = bars.withColumn("symbol", F.lit(data.get("symbol", "")))
    if "pos" in bars.columns:
        bars = bars.drop("pos")
    trigger = cfg["trigger"]
    prepared = cut(add_indicators(add_position(bars), **C.indicator_periods(cfg.get("indicators", {}), trigger)))
    boolean = not trigger.get("params", {}).get("signed", True)
    rows = D.build_dataset(
        prepared, C.build_trigger(trigger), C.build_features(cfg.get("features")),
        C.build(C.LABELERS, cfg["labeler"], "labeler"), boolean,
    )
    return prepared, cut(rows)


def run_research(spark: SparkSession, cfg: Mapping, out_dir: str) -> Research:
    """Dataset, yearly table, model and its ranking quality; without a ``model`` section no model.

    A test range also has its dataset written and its yearly table made.
    With ``test_range`` the model is judged out of sample; else with ``cv_folds`` above 1 by
    purged cross-validation; else on the last part of the rows.
    """
    data, model_cfg = cfg["data"], cfg.get("model") or {}
    target, params = model_cfg.get("target", "y_norm"), model_cfg.get("params", {})
    train_key = "train_range" if "train_range" in data else "date_range"
    bars, rows = config_dataset(spark, cfg, train_key)
    write_dataset(rows, f"{out_dir}/dataset")
    meta = D.dataset_meta(rows, bars, cfg)
    yearly = D.period_stats(rows) if "y_norm" in rows.columns else None
    test, test_yearly = None, None
    if "test_range" in data:
        test = config_dataset(spark, cfg, "test_range")[1]
        write_dataset(test, f"{out_dir}/dataset_test")
        test_yearly = D.period_stats(test) if "y_norm" in test.columns else None
    if not cfg.get("model"):
        return Research(rows, meta, yearly, None, None, None, test_yearly)
    names = M.feature_columns(rows)
    staircase = None
    if test is not None:
        model = M.train_regressor(rows, target, names, **params)
        scored = cut(M.score(model, test).select("score", target))
        ic, staircase = V.rank_ic(scored, "score", target), V.quantile_staircase(scored, "score", target)
    elif model_cfg.get("cv_folds", 1) > 1:
        k = model_cfg["cv_folds"]
        horizon = cfg["labeler"].get("params", {}).get("horizon", 14400)
        gap = V.event_gap(rows, horizon).select("gap").scalar()
        folds = V.purged_folds(V.time_index(rows), k, gap)
        ic = V.cv_summary(M.cross_validate(folds, k, target, names, **params))
        model = M.train_regressor(rows, target, names, **params)
    else:
        split = cut(V.chronological_split(V.time_index(rows), model_cfg.get("train_split", 0.8)))
        model = M.train_regressor(split.filter("role = 'train'"), target, names, **params)
        scored = cut(M.score(model, split.filter("role = 'test'")).select("score", target))
        ic, staircase = V.rank_ic(scored, "score", target), V.quantile_staircase(scored, "score", target)
    M.save_model(model, f"{out_dir}/{model_cfg.get('output_prefix', 'model')}")
    return Research(rows, meta, yearly, ic, staircase, model, test_yearly)
