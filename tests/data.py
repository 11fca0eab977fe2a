"""Small bar tables for tests."""

import numpy as np
import pandas as pd


def walk(seed: int, n: int, symbol: str = "X", step: float = 1.0, start: float = 200.0) -> pd.DataFrame:
    """A random walk with spikes, so that stops and channels on both sides are met."""
    rng = np.random.default_rng(seed)
    close = np.round(np.maximum(start + np.cumsum(rng.normal(0, step, n)), 20.0), 2)
    open_ = np.r_[close[0], close[:-1]]
    high = np.round(np.maximum(open_, close) + rng.exponential(step / 2, n), 2)
    low = np.round(np.minimum(open_, close) - rng.exponential(step / 2, n), 2)
    volume = rng.integers(0, 30, n).astype(float)
    return pd.DataFrame({
        "symbol": symbol, "pos": np.arange(n), "open_time": 1_672_531_200_000 + 60_000 * np.arange(n), "open": open_,
        "high": high, "low": low, "close": close, "volume": volume,
        "taker_buy_base": np.round(volume * rng.uniform(0.2, 0.8, n), 3), "trades_count": 1,
    })


def frame(spark, pdf: pd.DataFrame):
    """Spark table with NULL instead of NaN."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
