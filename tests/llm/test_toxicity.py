"""Toxicity: held-out ranking, the risk estimator, and edge cases."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.llm import toxicity
from sparkbars.llm.queries import op1_toxicity
from tests.llm.helpers import LABELS, documents


def auc(score, truth):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (order[truth].mean() - (truth.sum() - 1) / 2) / (~truth).sum()


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    score, truth = np.array([r["score"] for r in rows]), np.array([r["toxic"] == 1 for r in rows])
    assert auc(score, truth) > 0.95
    assert np.mean([r["predicted"] for r, t in zip(rows, truth) if not t]) < 0.01 and np.mean([r["predicted"] for r, t in zip(rows, truth) if t]) > 0.6
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_unlabelled_texts_may_hold_toxic_ones():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]

    def text(bad):
        return " ".join([*rng.choice(words, 25), *(["vile"] if bad else [])]).encode()

    positives, unknown = [text(True) for _ in range(150)], [text(i < 60) for i in range(600)]
    weights = toxicity.fit(positives + unknown, np.arange(750) < 150, 0.1, toxicity.Settings(epochs=30, batch=64), 1)
    scorer = toxicity.Scorer(weights)
    assert all(scorer.margin(text(True)) > 0 > scorer.margin(text(False)) for _ in range(50))
    assert scorer.margin(None) == scorer.margin(b"") == scorer.constant


def test_labels_outside_the_folds_are_not_learned(spark, tmp_path):
    texts = [("vile words " if i % 3 == 0 else "nice words ") + f"here {i % 7}" for i in range(200)]
    from zlib import crc32

    held = [crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    results = []
    for k, flip in enumerate((0, 1)):
        path = tmp_path / str(k)
        path.mkdir()
        labels = [(i, 1, int(i % 3 == 0) ^ (flip if held[i] else 0)) for i in range(200)]
        rows = op1_toxicity(spark, documents(path, texts, labels=(LABELS, labels))).collect()
        assert {r["doc_id"]: r["held_out"] for r in rows} == dict(enumerate(held))
        results.append({r["doc_id"]: r["score"] for r in rows})
    assert results[0] == results[1]


def test_odd_rows_and_missing_labels(spark, tmp_path):
    texts = [None, "", "...", "a", "a", "long " * 200_000, *["plain text of words"] * 30, *["vile text"] * 10]
    for k, labels in enumerate(([], [(0, 1, None), (1, 1, 0)], [(i, 1, int(i >= 36)) for i in range(46)] + [(40, 1, 1), (None, 1, 1), (99_999, 0, 1)])):
        path = tmp_path / str(k)
        path.mkdir()
        rows = op1_toxicity(spark, documents(path, texts, labels=(LABELS, labels))).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert k == 2 or {r["score"] for r in rows} == {0.0}


def test_the_sample_is_bounded(spark):
    drawn = spark.range(4000).filter(toxicity._drawn(F.col("id"), 11) < 100 / 4000).count()
    assert 50 < drawn < 160


def test_empty_documents(spark, tmp_path):
    assert op1_toxicity(spark, documents(tmp_path, [], labels=(LABELS, [(1, 1, 1), (2, 0, 0)]))).collect() == []


def plain_fit(texts, positive, prior, s, seed):
    """The classifier text by text and bucket by bucket, with the same draws."""
    rows = [sorted(toxicity.Features().of(t)) for t in texts]
    known, unknown = [i for i, p in enumerate(positive) if p], [i for i, p in enumerate(positive) if not p]
    useful = set()
    for b in {b for i in known for b in rows[i]}:
        held = sum(b in rows[i] for i in known)
        share = (sum(b in rows[i] for i in unknown) + 0.5) / (len(unknown) + 1)
        if held >= 3 and held - len(known) * share >= s.lift * math.sqrt(len(known) * share * (1 - share)):
            useful.add(b)
    rows = [[b for b in r if b in useful] for r in rows]
    weight, moment, constant, constant_moment, clamped = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8, 0
    random = np.random.default_rng(seed)
    for _ in range(s.epochs):
        for part in np.array_split(random.permutation(unknown), max(len(unknown) // s.batch, 1)):
            drawn = random.choice(known, min(len(known), max(len(part) // 4, 1)), replace=False)
            margin = {i: sum(weight[b] for b in rows[i]) + constant for i in (*drawn, *part)}
            clean_loss = lambda i: math.log1p(math.exp(margin[i]))  # noqa: B023, E731
            toxic = lambda i: 1 / (1 + math.exp(-margin[i]))  # noqa: B023, E731
            # risk of calling unknown texts clean, less the share of it that toxic ones among them cause
            rest = sum(map(clean_loss, part)) / len(part) - prior * sum(map(clean_loss, drawn)) / len(drawn)
            if rest >= 0:
                slope = {i: -prior * (1 - toxic(i)) / len(drawn) - prior * toxic(i) / len(drawn) for i in drawn}
                slope |= {i: toxic(i) / len(part) for i in part}
            else:
                clamped += 1
                slope = {i: -prior * (1 - toxic(i)) / len(drawn) for i in drawn}
            step = defaultdict(float)
            for i, value in slope.items():
                for b in rows[i]:
                    step[b] += value
            for b in useful:
                moment[b] += step[b] ** 2
                rate = s.rate / math.sqrt(moment[b])
                w = weight[b] - rate * step[b]
                weight[b] = math.copysign(max(abs(w) - rate * s.pull, 0.0), w)
            total = sum(slope.values())
            constant_moment += total**2
            constant -= s.rate * total / math.sqrt(constant_moment)
    return weight, constant, clamped


@pytest.mark.parametrize("prior", [0.05, 0.6])
def test_fit_equals_a_plain_version(prior):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*rng.choice(words, 12), *(["vile", "nasty"] if i < 40 else ["vile"] if i < 50 else [])]).encode() for i in range(200)]
    positive = np.arange(200) < 40
    settings = toxicity.Settings(epochs=6, batch=16, lift=2.0)
    weights = toxicity.fit(texts, positive, prior, settings, 5)
    plain, constant, clamped = plain_fit(texts, positive, prior, settings, 5)
    want = np.zeros(toxicity.BUCKETS)
    for b, w in plain.items():
        want[b] = w
    np.testing.assert_allclose(weights[:-1], want, rtol=1e-9, atol=1e-12)
    assert abs(weights[-1] - constant) < 1e-9 and np.count_nonzero(want) > 3
    assert clamped > 0 or prior < 0.5  # a high prior drives the estimate below 0, where it is cut off


def test_clashing_extra_columns(spark):
    docs = spark.createDataFrame([(i, "vile text" if i % 2 else "nice text", 9, 9, 9) for i in range(60)], "doc_id long, text string, toxic int, positive int, drawn int")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(0, 60, 3)], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    assert docs.select(model.score(F.col("text")).alias("score")).filter("score between 0 and 1").count() == 60
