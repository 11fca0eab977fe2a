"""Event features as columns over an indicator table.

A feature is a dict of name to column. One definition serves a batch of events, a
single bar and a stream, because it reads only columns of its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.functions.signals import intensities

FeatureSet = dict[str, Column]
Feature = Callable[[DataFrame], FeatureSet]


def _value(df: DataFrame, name: str, fallback: float | None = None) -> Column:
    """An indicator column; the fallback stands in where it is NULL or absent."""
    if name not in df.columns:
        return F.lit(fallback).cast("double")
    c = F.col(name)
    return c if fallback is None else F.coalesce(c, F.lit(fallback))


def atr_feature(df: DataFrame) -> FeatureSet:
    atr, close = _value(df, "atr", 0.0), F.col("close")
    return {"atr": atr, "atr_pct": F.when(close > 0, atr / close).otherwise(F.lit(0.0))}


def breakout_intensity(df: DataFrame) -> FeatureSet:
    up, down = intensities(F.col("close"), _value(df, "entry_high"), _value(df, "entry_low"), _value(df, "atr"))
    return {"long_intensity": F.coalesce(up, F.lit(0.0)), "short_intensity": F.coalesce(down, F.lit(0.0))}


def volume_ratio(df: DataFrame) -> FeatureSet:
    return {"vol_ratio": _value(df, "vol_ratio", 1.0), "vol_zscore": _value(df, "vol_zscore", 0.0)}


def channel_position(df: DataFrame) -> FeatureSet:
    return {"channel_pos": _value(df, "channel_pos", 0.5)}


def channel_width(df: DataFrame) -> FeatureSet:
    close = F.col("close")
    width = F.when(close > 0, (_value(df, "entry_high") - _value(df, "entry_low")) / close)
    return {"channel_width_pct": F.coalesce(width, F.lit(0.0))}


def lagged_returns(df: DataFrame) -> FeatureSet:
    return {f"ret_{k}": _value(df, f"ret_{k}", 0.0) for k in (5, 10, 30)}


def taker_flow(df: DataFrame) -> FeatureSet:
    return {"taker_buy_ratio": _value(df, "taker_buy_ratio", 0.5)}


def trend_filter(df: DataFrame, band: float = 0.01) -> FeatureSet:
    ma = _value(df, "ma")
    ratio = F.when(ma > 0, F.col("close") / ma)
    direction = F.when(ratio > 1 + band, F.lit(1.0)).when(ratio < 1 - band, F.lit(-1.0)).otherwise(F.lit(0.0))
    return {"trend_direction": direction, "ma_ratio": F.coalesce(ratio, F.lit(1.0))}


def hour_of_day(df: DataFrame) -> FeatureSet:
    if "datetime" in df.columns:
        return {"hour_of_day": F.hour("datetime").cast("double")}
    if "open_time" in df.columns:
        hour = F.floor(F.pmod(F.col("open_time"), F.lit(86_400_000)) / 3_600_000)
        return {"hour_of_day": hour.cast("double")}
    return {"hour_of_day": F.lit(0.0)}


DEFAULT_FEATURES: tuple[Feature, ...] = (
    atr_feature,
    breakout_intensity,
    volume_ratio,
    channel_position,
    channel_width,
    lagged_returns,
    taker_flow,
    trend_filter,
)


def compose(features: Sequence[Feature]) -> Feature:
    """One feature out of several; a later one wins where names repeat."""

    def merged(df: DataFrame) -> FeatureSet:
        out: FeatureSet = {}
        for feature in features:
            out |= feature(df)
        return out

    return merged


def default_feature_set() -> Feature:
    return compose(DEFAULT_FEATURES)


def feature_names(features: Feature, df: DataFrame) -> list[str]:
    return list(features(df))


def compute_features(df: DataFrame, features: Feature, keys: Sequence[str] = ("symbol", "pos")) -> DataFrame:
    """Feature columns of every row of ``df``; filter to events, or to one bar, before the call."""
    return df.select(*keys, *[c.alias(n) for n, c in features(df).items()])
