"""Product quantisation against all pairs, its SQL twin, and the bounds that make it lossless."""

import numpy as np
import pyarrow as pa
import pytest

from sparkbars.llm import embeddings
from sparkbars.llm.queries import ORACLES, op13_embedding_neighbours
from tests.llm.helpers import folder, result, twin

NAME = "op13_embedding_neighbours"
SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
REACH = float(np.sqrt(2 - 2 * embeddings.MIN_COSINE))


def plain(rows, limit=embeddings.MIN_COSINE):
    """{vec_id: (n_links, component_id, kept)} by comparing all pairs."""
    def usable(v, label):
        return label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    root, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (i, v, label) in enumerate(rows):
        for j, w, other in rows[:k]:
            if label == other and usable(v, label) and usable(w, other) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= limit:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    low, high = sorted((find(i), find(j)))
                    root[high] = low
    return {i: (links[i], find(i), find(i) == i) for i in root}


def table(rng, n, dim=24):
    """Vectors around a few directions, so that many pairs lie on both sides of the limit, with copies and chains."""
    hubs = rng.normal(size=(6, dim))
    x = hubs[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.25, 0.3, 0.6], (n, 1))
    x = x.astype(np.float32)
    x[n // 2 : n // 2 + n // 8] = x[0]
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in zip(rng.permutation(n), x)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), rows[0][1][:7], rows[0][1][:7]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 50, rows[0][1], None), (n + 51, [3e38] * dim, 0), (n + 52, [1e-38] * dim, 0)]
    return rows


@pytest.mark.parametrize("slice_rows, list_rows", [(4096, 2048), (16, 20)])
def test_matches_all_pairs_whatever_the_lists(spark, tmp_path, monkeypatch, slice_rows, list_rows):
    monkeypatch.setattr(embeddings, "SLICE", slice_rows)
    monkeypatch.setattr(embeddings, "LIST_ROWS", list_rows)
    rows = table(np.random.default_rng(list_rows), 400)
    got = op13_embedding_neighbours(spark, folder(tmp_path, embeddings=(SCHEMA, rows))).collect()
    want = plain(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want and len(got) == len(rows)
    assert sum(n for n, *_ in want.values()) > 2000 and sum(kept for *_, kept in want.values()) > 50


def test_matches_sql(spark, tmp_path):
    rows = [r for r in table(np.random.default_rng(3), 200) if r[0] < 200 or r[0] == 250]
    path = folder(tmp_path, embeddings=(SCHEMA, rows))
    assert result(op13_embedding_neighbours(spark, path)) == twin(ORACLES[NAME], path, "embeddings")


def test_probes_and_estimates_lose_no_near_vector():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)) * np.linspace(1.5, 0.1, 32)
    x[700:] = x[rng.integers(0, 700, 800)] + rng.normal(size=(800, 32)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = embeddings.Codebooks.fit(x[:600], 40)  # most vectors were never seen
    own, codes, missed = books.encode(x)
    probed = books.probes(x, REACH)
    true = np.argwhere(x @ x.T >= embeddings.MIN_COSINE)
    assert len(true) > 3000 and probed[true[:, 0], own[true[:, 1]]].all() and probed.mean() < 0.9
    found = set()
    for which in range(40):
        seek, held = np.flatnonzero(probed[:, which]), np.flatnonzero(own == which)
        for a, b in books.near(x[seek], which, codes[held], missed[held], REACH):
            found.update(zip(seek[a].tolist(), held[b].tolist()))
    assert set(map(tuple, true.tolist())) <= found and len(found) < 0.5 * len(x) ** 2


def test_codebooks_need_not_fit_the_vectors():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(50, 16)), 4, axis=0) + rng.normal(size=(200, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = embeddings.Codebooks.fit(-x[:3], 3)
    own, codes, missed = books.encode(x)
    pairs = {(i, j) for w in range(3) for a, b in books.near(x, w, codes[own == w], missed[own == w], REACH)
             for i, j in zip(a.tolist(), np.flatnonzero(own == w)[b].tolist())}
    assert {tuple(p) for p in np.argwhere(x @ x.T >= embeddings.MIN_COSINE).tolist()} <= pairs


def test_repeated_ids_missing_ids_and_empty_table(spark, tmp_path):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    path = folder(tmp_path, embeddings=(SCHEMA, [(5, v, 1), (5, v, 1), (None, v, 1), (9, v, 2), (3, w, 1), (None, w, 2)]))
    got = sorted(map(str, (tuple(r) for r in op13_embedding_neighbours(spark, path).collect())))
    assert got == sorted(map(str, [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (9, 0, 9, True), (3, 0, 3, True), (None, 0, None, False)]))
    folder(tmp_path, embeddings=(SCHEMA, []))
    assert result(op13_embedding_neighbours(spark, path)) == []


def test_clashing_extra_columns(spark):
    names = ["vec_id", "label", "embedding", "key", "entry", "n", "list", "value", "copies", "group"]
    df = spark.createDataFrame([(i, "x", [1.0, float(i % 2)], *"abcdefg") for i in range(6)], names)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()) == [
        (i, 2, i % 2) for i in range(6)]
