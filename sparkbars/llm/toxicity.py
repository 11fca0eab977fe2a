"""Toxicity by non-negative positive-unlabelled learning.

Known are some toxic texts (positives) and any number of texts of unknown kind. With the
share ``prior`` of toxic texts, the risk of calling unknown texts clean is the loss on all
unknown texts minus ``prior`` times the loss on positives. Where that estimate falls below
zero, which no risk can, it counts as zero, and the step follows the positives alone (Kiryo et al., 2017).

The features of a text are the hashes of its distinct words and of their byte n-grams, the
margin is a constant plus the weights of the distinct features. Only features get a weight
that are in more positives than their share of unknown texts explains, by ``lift`` standard
deviations, and weights that carry little are pulled to zero: a few telling words then count
as much in a long text as in a short one. Several classifiers learn on a bounded sample, one Spark group each, all from the same
positives and each from its own share of unlabelled texts; their weights are averaged.

Bounds: about ``positives`` and ``unlabelled`` rows are drawn by a hash of the id, all of them if there
are fewer. Everything else covers all rows. Defined results: a NULL text or one without a
word has the margin of the constant alone; without any positive example every score is the prior, 0 if nothing is labelled;
repeated ids are drawn together; rows without an id teach nothing; very long texts are scored whole; an empty table
gives no rows; other columns than the ones named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.llm.columns import only
from sparkbars.llm.decontaminate import words_of
from sparkbars.session import cut

BUCKETS = 1 << 18
GRAM = 4
MEMO_WORDS = 100_000
MEMO_BYTES = 64
MIN_POSITIVES = 3


@dataclass(frozen=True)
class Settings:
    positives: int = 4_000
    unlabelled: int = 24_000
    classifiers: int = 3
    epochs: int = 16
    batch: int = 512
    rate: float = 0.1
    pull: float = 3e-4
    lift: float = 5.0
    seed: int = 11


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of the word itself and of its n-grams."""
    marked = b"^" + word + b"$"
    return (crc32(word, 1) % BUCKETS, *[crc32(marked[i : i + GRAM]) % BUCKETS for i in range(max(len(marked) - GRAM + 1, 1))])


class Features:
    """Distinct buckets of texts, all of them or only those marked as ``useful``; keeps a bounded memo of words."""

    def __init__(self, useful: np.ndarray | None = None):
        self.useful = None if useful is None else set(np.flatnonzero(useful).tolist())
        self.memo: dict[bytes, tuple] = {}

    def of(self, text: bytes | None) -> set:
        known, out = self.memo.get, set()
        for word in set(words_of(text)):
            buckets = known(word)
            if buckets is None:
                buckets = word_features(word)
                if self.useful is not None:
                    buckets = tuple(self.useful.intersection(buckets))
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                if len(word) <= MEMO_BYTES:
                    self.memo[word] = buckets
            if buckets:
                out.update(buckets)
        return out


def _lifted(known: list, unknown: list, lift: float) -> np.ndarray:
    """True for buckets that positives hold more often than unknown texts do."""
    held = np.bincount(np.concatenate(known), minlength=BUCKETS)
    share = (np.bincount(np.concatenate(unknown), minlength=BUCKETS) + 0.5) / (len(unknown) + 1)
    spread = np.sqrt(len(known) * share * (1 - share))
    return (held >= MIN_POSITIVES) & (held - len(known) * share >= lift * spread)


def fit(texts: list, positive: np.ndarray, prior: float, settings: Settings, seed: int) -> np.ndarray:
    """Weights of one classifier, the constant last."""
    weights, moment, constant, constant_moment = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    known, unknown = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(known) or not len(unknown):
        return np.r_[weights, constant]
    found = Features()
    rows = [np.fromiter(sorted(found.of(t)), np.int32) for t in texts]
    lifted = _lifted([rows[i] for i in known], [rows[i] for i in unknown], settings.lift)
    rows = [r[lifted[r]] for r in rows]
    size = np.array([len(r) for r in rows])
    start, index = np.r_[0, np.cumsum(size)], np.concatenate(rows)
    random = np.random.default_rng(seed)
    steps = max(len(unknown) // settings.batch, 1)
    for _ in range(settings.epochs):
        for part in np.array_split(random.permutation(unknown), steps):
            chosen = np.r_[random.choice(known, min(len(known), max(len(part) // 4, 1)), replace=False), part]
            n_known, length = len(chosen) - len(part), size[chosen]
            at = np.repeat(start[chosen] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            owner, used = np.repeat(np.arange(len(chosen)), length), index[at]
            margin = np.bincount(owner, weights[used], len(chosen)) + constant
            toxic = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
            loss = np.logaddexp(0, margin)  # of calling it clean
            slope = np.zeros(len(chosen))
            if loss[n_known:].mean() >= prior * loss[:n_known].mean():
                # slope of prior * (toxic loss - clean loss) on positives, which is constant, and of the clean loss on the unknown
                slope[:n_known], slope[n_known:] = -prior / n_known, toxic[n_known:] / len(part)
            else:
                slope[:n_known] = -prior * (1 - toxic[:n_known]) / n_known
            step = np.bincount(used, slope[owner], BUCKETS)
            moment += step * step
            rate = settings.rate / np.sqrt(moment)
            weights -= rate * step
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * settings.pull, 0)
            constant_moment += slope.sum() ** 2
            constant -= settings.rate * slope.sum() / np.sqrt(constant_moment)
    return np.r_[weights, constant]


class Scorer:
    """Margins of texts by weights."""

    def __init__(self, weights: np.ndarray):
        self.constant, self.features = float(weights[-1]), Features(weights[:-1] != 0)
        self.weight = {int(b): float(weights[b]) for b in np.flatnonzero(weights[:-1])}

    def margin(self, text: bytes | None) -> float:
        return fsum(map(self.weight.__getitem__, self.features.of(text))) + self.constant


def _fitted(prior: float, settings: Settings):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("drawn").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        positive = group.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        texts = group.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        weights = fit(texts, positive, prior, settings, settings.seed + key[0].as_py())
        return pa.table({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    return run


def _drawn(doc_id: Column, seed: int) -> Column:
    """A number below 1 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> Model:
    """Learns from the toxic rows of ``labels`` and from unlabelled rows of ``docs``.

    Both must already be free of rows to hold out. The prior is the toxic share of ``labels``.
    """
    spark = docs.sparkSession
    known = only(labels, doc_id, toxic).filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(toxic) == 1).cast("long")), F.lit(0))).first()
    prior = n_toxic / n if n else 0.0
    if not 0 < prior < 1:
        return Model(spark, None, prior)
    texts = only(docs, doc_id, text).filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    draw, bag = _drawn(F.col(doc_id), settings.seed), F.pmod(F.xxhash64(F.lit(settings.seed), F.col(doc_id)), F.lit(settings.classifiers)).cast("int")
    wanted = known.filter(F.col(toxic) == 1).select(doc_id).distinct()
    wanted = cut(wanted.filter(draw < settings.positives / n_toxic))
    every = F.explode(F.sequence(F.lit(0), F.lit(settings.classifiers - 1)))
    positive = texts.join(wanted, doc_id, "left_semi").select(every.alias("bag"), draw.alias("drawn"), F.lit(True).alias("positive"), F.col(text).alias("text"))
    unknown = texts.filter(draw >= 1 - settings.unlabelled / max(texts.count(), 1)).select(
        bag.alias("bag"), draw.alias("drawn"), F.lit(False).alias("positive"), F.col(text).alias("text")
    )
    sample = positive.unionByName(unknown)
    rows = sample.groupBy("bag").applyInArrow(_fitted(prior, settings), "weights binary").collect()
    if not rows:
        return Model(spark, None, prior)
    return Model(spark, np.mean([np.frombuffer(r[0], "<f8") for r in rows], axis=0), prior)


class Model:
    """Averaged weights, broadcast; their size is fixed by the number of buckets."""

    def __init__(self, spark: SparkSession, weights: np.ndarray | None, prior: float):
        self.prior = prior
        self.shared = None if weights is None else spark.sparkContext.broadcast(weights)

    def score(self, text: Column) -> Column:
        """Probability of being toxic, from 0 to 1."""
        if self.shared is None:
            return F.lit(float(self.prior))
        shared = self.shared

        @F.arrow_udf(T.DoubleType())
        def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Scorer(shared.value)
            for batch in batches:
                yield pa.array([own.margin(t) for t in batch.cast(pa.binary()).to_pylist()], pa.float64())

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margins(text)))
