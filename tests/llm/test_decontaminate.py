"""Decontamination against its SQL twin, plain matching and edge cases."""

import random

import numpy as np
import pytest

from sparkbars.llm import decontaminate
from sparkbars.llm.queries import ORACLES, op4_decontaminate
from tests.llm.helpers import BENCHMARK, documents, folder, result, twin

NAME = "op4_decontaminate"


def tables(path, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "x1", "naïve", "zz"] + [f"w{i}" for i in range(rng.choice([2, 30]))]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "!?"), (33, items[3][1]), (3, items[3][1]), (None, say(12)), (34, "short"), (35, say(9) + " same same")]
    texts = [None, "", "...", "short", "Short, SHORT"]
    for _ in range(80):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, max(len(words) - 1, 0))
            parts += [", ".join(words[at : at + rng.randint(1, 20)]).upper(), say(rng.randint(0, 5))]
        texts.append(" - ".join(parts))
    texts += [texts[20], texts[20], (items[0][1] + " ") * 60]
    folder(path, benchmark=(BENCHMARK, items))
    return documents(path, texts)


@pytest.mark.parametrize("seed, block, shard", [(1, 1 << 19, 1 << 20), (2, 40, 1 << 20), (3, 1 << 19, 50)])
def test_matches_sql(spark, tmp_path, monkeypatch, seed, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    path = tables(tmp_path, seed)
    assert result(op4_decontaminate(spark, path)) == twin(ORACLES[NAME], path, "documents", "benchmark")


def test_longest_matches_and_their_places(spark):
    item = [f"i{k}" for k in range(25)]
    docs = spark.createDataFrame([(1, " ".join(["a", *item[3:20], "b", *item, "c"]), 0)], "doc_id long, text string, contamination int")
    bench = spark.createDataFrame([(7, " ".join(item), "x")], "item_id long, text string, extra string")
    with pytest.raises(ValueError):
        decontaminate.find_matches(docs, bench)
    row = decontaminate.find_matches(docs, bench, out="found").first()["found"]
    assert [tuple(m) for m in row["matches"]] == [("7", 3, 1, 17), ("7", 0, 19, 25)]
    assert row["n_words"] == 45


def test_suffix_array_orders_by_ten_words():
    rng = np.random.default_rng(0)
    for size in (3, 5000):
        ids = rng.integers(0, size + 1, 400)
        ids[rng.integers(0, 400, 20)] = 0
        padded = np.r_[ids, np.zeros(decontaminate.WINDOW, int)]

        def window(p, padded=padded):
            return tuple(padded[p : p + decontaminate.WINDOW])

        got = [window(p) for p in decontaminate.suffix_array(ids, size)]
        # words behind an unknown one are no longer told apart
        known = [g[: g.index(0)] if 0 in g else g for g in got]
        assert len(got) == (ids > 0).sum() and known == sorted(known)


def test_remove_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "clean words only", 1), (2, "the one two three", 2), (3, None, 3), (2, "the one two three", 2)],
                                 "doc_id long, text string, contamination int")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.remove(docs, bench).select("doc_id", "contamination").collect()) == [(1, 1), (3, 3)]
    assert decontaminate.remove(docs, bench.filter("false")).count() == 4
    assert decontaminate.remove(docs.filter("false"), bench).collect() == []


def test_a_shared_window_stays_linear(spark, tmp_path):
    """One window in 1,000 items and 1,000 texts: a text carries the window once, and the items are found once for all of them."""
    shared = " ".join(f"s{k}" for k in range(10))
    path = documents(tmp_path, [f"own{i} {shared}" for i in range(1000)])
    folder(path, benchmark=(BENCHMARK, [(i, f"{shared} item{i}") for i in range(1000)]))
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = decontaminate.find_hits(docs, bench).select("contamination.*").collect()
    assert all(len(r["windows"]) == 1 and [tuple(x) for x in r["spans"]] == [(1, 10)] for r in hits)
    sets = decontaminate.items_of(decontaminate.find_hits(docs, bench).select("contamination.windows"), bench).collect()
    assert len(sets) == 1 and sets[0]["items"] == sorted(map(str, range(1000)))
    rows = op4_decontaminate(spark, path).collect()
    assert {(r["n_words"], r["n_hit"], r["n_items"]) for r in rows} == {(11, 10, 1000)}


def test_very_long_text_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    item = [f"i{k}" for k in range(14)]
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    words[300_000:300_000] = item
    docs = spark.createDataFrame([(1, " ".join(words), 5, 6)], "doc_id long, text string, block_0 int, windows int")
    bench = spark.createDataFrame([(7, " ".join(item), "x")], "item_id long, text string, window string")
    row = decontaminate.find_hits(docs, bench).first()
    assert [tuple(x) for x in row["contamination"]["spans"]] == [(300_000, 14)] and (row["block_0"], row["windows"]) == (5, 6)
    assert len(row["contamination"]["windows"]) == 5 and decontaminate.remove(docs, bench).count() == 0
