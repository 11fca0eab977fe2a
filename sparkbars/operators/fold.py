"""Ordered folds: state that each row hands to the next one of its key.

Only for steps that truly need the previous result, such as capital that compounds
trade by trade. Rows are hashed by key and sorted inside their partition by Spark
(spilling to disk when they must), then stream through the fold batch by batch, so
memory stays at one batch plus one state whatever the size of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# step(rows of one key in order, state or None) -> (output rows, state)
Step = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            changed = np.zeros(len(batch), dtype=bool)
            for k in keys:
                v = batch[k].to_numpy()
                changed[1:] |= v[1:] != v[:-1]
            bounds = [0, *np.flatnonzero(changed).tolist(), len(batch)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                piece = batch.iloc[a:b]
                key = tuple(piece[k].iat[0] for k in keys)
                if key != current:
                    current, state = key, None
                out, state = step(piece, state)
                if len(out):
                    yield out

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )
