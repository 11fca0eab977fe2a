"""Fingerprints and components against plain versions; dense groups, splits and edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkbars.llm import simhash
from sparkbars.llm.components import components
from sparkbars.llm.queries import op3_simhash_components
from tests.llm.helpers import documents

M64 = (1 << 64) - 1


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_roots(prints):
    p = np.array(prints, np.uint64)
    return roots(len(p), [(i, int(j)) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 4) + i + 1])


def planted(rng, groups, size, flips):
    """Random fingerprints and clouds around some of them."""
    out = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(groups):
        centre, bits = rng.getrandbits(64), rng.sample(range(64), 12)
        for _ in range(size):
            out.append(centre ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, flips))))
    return [x & M64 for x in out] + [0, 0, 0b111, 0b1111, 0b11111, M64, M64 - 1]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("target, limit", [(1024, 4096), (4, 4096), (8, 16)])
def test_components_match_all_pairs(spark, monkeypatch, target, limit):
    monkeypatch.setattr(simhash, "NODE_TARGET", target)
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    prints = planted(random.Random(target), 6, 60, 4)
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["first"]["doc_id"] for r in simhash.grouped(df).collect()}
    assert [got[i] for i in range(len(prints))] == plain_roots(prints)


def test_traversal_of_small_and_large_sides():
    rng = random.Random(9)
    for _ in range(40):
        depth = rng.choice([0, 3, 21])
        top = rng.getrandbits(depth) << (64 - depth) if depth else 0
        keys = list({top | (rng.getrandbits(64) >> depth) & rng.choice([M64, 0xFFF, 0x3F]) for _ in range(rng.randint(1, 300))})
        keys = np.array(keys, np.uint64)
        at, root = simhash.traverse(keys, np.zeros(len(keys), bool), depth, depth)
        got = np.empty(len(keys), int)
        got[at] = root
        want = plain_roots([int(k) for k in keys])
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_query_matches_plain_fingerprints(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["É", "Z", "ß", " x"]
    texts = [None, "", "  \n", "One", "one", "a b c", "A b  c", "a b c d e"]
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([5, 80, 400]))
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rng.randrange(len(near))] = "edit"
            texts.append("\t".join(near).upper())
    texts += ["word " * 300_000, texts[20], texts[20]]
    rows = {r["doc_id"]: r for r in op3_simhash_components(spark, documents(tmp_path, texts)).collect()}
    prints = [plain_print(t) for t in texts[:-3]] + [plain_print("word " * 10), plain_print(texts[20]), plain_print(texts[20])]
    assert [int(rows[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == plain_roots(prints)


def test_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, 0), (3, text.upper(), 1), (None, text, 2), (9, "other words in here", 3), (9, "other words in here", 3), (9, "a text of its own kind", 4),
            (None, "nobody knows this one", 5), (8, None, 6), (7, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[5], rows[6], rows[8]], key=str)
    assert simhash.keep_one(docs.filter("false")).collect() == []


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, j) for j in range(201, 260)] + [(7, 7)]
    edges += [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] * 2
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).select("node", "root").collect())
    want = roots(300, edges)
    assert all(got.get(i, i) == want[i] for i in range(300))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint_column_is_a_long(spark):
    got = spark.createDataFrame([("x",)], "t string").select(simhash.fingerprint(F.col("t")).alias("f"))
    assert got.dtypes == [("f", "bigint")]


def test_query_on_an_empty_table(spark, tmp_path):
    assert op3_simhash_components(spark, documents(tmp_path, [])).collect() == []
