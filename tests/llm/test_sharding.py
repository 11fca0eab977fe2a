"""Sharding against its SQL twin, limits, and rows that no hash bit can part."""

import random
from collections import defaultdict

import pytest

from sparkbars.llm import sharding
from sparkbars.llm.queries import ORACLES, SHARD_BYTES, op5_shards
from tests.llm.helpers import documents, result, twin

NAME = "op5_shards"


def some(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, depth int")


@pytest.mark.parametrize("limit, step", [(200, 20), (60, 2), (10_000, 20)])
def test_buckets_split_only_while_too_large(spark, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    rng = random.Random(limit)
    texts = ["x" * rng.randint(0, 50) for _ in range(300)] + [None, ""]
    rows = sharding.assign(some(spark, texts), limit).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for shard, own in by.items():
        size = sum(r["n_bytes"] for r in own)
        assert size <= limit and {(r["shard_bytes"], r["shard_rows"], r["depth"], r["slice"], r["over_limit"]) for r in own} == {(size, len(own), len(shard), 0, False)}
        if shard:
            family = sum(r["n_bytes"] for s, other in by.items() for r in other if s.startswith(shard[:-1]))
            assert family > limit


def test_matches_sql_with_a_split(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aé ", k=rng.randint(0, 90_000))) for _ in range(120)] + [None, ""]
    path = documents(tmp_path, texts)
    got = result(op5_shards(spark, path))
    assert got == twin(ORACLES[NAME], path, "documents") and SHARD_BYTES == 1 << 20


def test_equal_rows_are_dealt_into_slices(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CHUNK_BITS", 3)
    texts = ["same"] * 100 + [f"other {i}" for i in range(20)] + ["one row far over the limit"]
    ids = [7] * 100 + [None] * 20 + [1]
    rows = sharding.assign(some(spark, texts, ids).repartition(4), 20).collect()
    assert len(rows) == len(texts)
    slices = defaultdict(int)
    for r in rows:
        slices[r["shard"], r["slice"]] += r["n_bytes"]
        assert r["over_limit"] == (r["doc_id"] == 1)
    assert all(size <= 20 or size == len(texts[-1]) for size in slices.values())
    assert len({r["slice"] for r in rows if r["doc_id"] == 7}) == 20
    assert all(slices[r["shard"], r["slice"]] == r["shard_bytes"] for r in rows)


def test_empty_table(spark):
    assert sharding.assign(some(spark, ["x"]).filter("false"), 20).collect() == []


def test_very_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, "a", 1, 2), (2, "short", "b", 1, 2), (3, None, "c", 1, 2)],
                               "doc_id long, text string, shard string, slice int, n_bytes int")
    rows = {r["doc_id"]: r for r in sharding.assign(df, 1 << 20).collect()}
    assert rows[1]["over_limit"] and rows[1]["shard_bytes"] == rows[1]["n_bytes"] == 3_000_000 and rows[1]["shard_rows"] == 1
    assert not rows[2]["over_limit"] and rows[3]["n_bytes"] == 0
