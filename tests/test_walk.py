"""Paths through successors against a plain walk."""

import numpy as np
import pandas as pd
import pytest

from sparkbars.operators.walk import path


def plain(steps):
    out, i = [], 0
    while i is not None and i < len(steps):
        out.append(i)
        i = steps[i]
    return out


def made(rng, n, far):
    """Successors up to ``far`` ahead; a few paths end early, others point beyond the last node."""
    return [None if rng.random() < 0.002 else int(i + rng.integers(1, far + 1)) for i in range(n)]


@pytest.mark.parametrize("rows", [7, 100, 4096])
def test_path_equals_walk_whatever_the_blocks(spark, rows):
    rng = np.random.default_rng(rows)
    keys = {("a", 1): made(rng, 900, 3), ("a", 2): made(rng, 700, 60), ("b", 1): made(rng, 400, 390), ("c", 1): [None], ("d", 1): [1] * 1 + [5]}
    table = [(*k, i, to) for k, steps in keys.items() for i, to in enumerate(steps)]
    nodes = spark.createDataFrame(table, "name string, n int, index long, next long")
    got = path(nodes.sample(1.0).repartition(5), ["name", "n"], rows).toPandas()
    for k, steps in keys.items():
        mine = got[(got.name == k[0]) & (got.n == k[1])]
        assert sorted(mine["index"]) == plain(steps), k


def test_long_strides_skip_blocks(spark):
    steps = [i + 37 for i in range(2000)]
    nodes = spark.createDataFrame(pd.DataFrame({"k": 0, "index": range(2000), "next": steps}))
    assert sorted(r["index"] for r in path(nodes, ["k"], 10).collect()) == list(range(0, 2000, 37))


def test_no_nodes(spark):
    assert path(spark.createDataFrame([], "k int, index long, next long"), ["k"]).collect() == []
