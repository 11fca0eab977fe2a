"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every partition and adds them up in Spark; the
driver receives one row of buckets per language, whose size does not depend on the corpus.
Scoring is a map over the texts: n-grams of many texts are hashed together in numpy and
their log-probabilities are summed per text.

Defined results: a NULL text or one without a letter is ``und`` with score 0; with no
labelled row at all every text is ``und``; rows without a language teach nothing; repeated
rows count as often as they appear; equal scores go to the language that sorts first; very long texts are judged
whole; an empty table gives no rows; extra columns stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.llm.columns import only, verdict_filter

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
BLOCK_CHARS = 1 << 19
LANGUAGES_PER_BLOCK = 64
MAX_LANGUAGES = 4096


def letter_table() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


def blocks(texts: list, size: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts, cut into blocks of about ``size``: (rows, starts, codes).

    Every piece begins with the two characters before it, blanks at the start of a text,
    so that a text cut into several pieces has the same n-grams as a whole one.
    """
    rows, starts, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = "  " + text.lower() + " "
        for at in range(2, len(text), size):
            piece = text[at - 2 : at + size]
            rows.append(row)
            starts.append(total)
            parts.append(piece)
            total += len(piece)
            if total >= size:
                yield np.array(rows), np.array(starts), codes_of(parts)
                rows, starts, parts, total = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), codes_of(parts)


def codes_of(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(codes: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that ends at every position.

    Bucket 0 stands for "nothing": n-grams without a letter, and those that end in the two
    leading characters of a piece.
    """
    is_letter = letters[codes].astype(bool)
    kept = np.where(is_letter, codes, 0).astype(np.uint32)
    mixed, some = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for back in range(max(ORDERS)):
        mixed[back:] = mixed[back:] * np.uint32(31) + (kept[: len(kept) - back] + np.uint32(7 * back + 1)) * np.uint32(0x9E3779B1)
        some[back:] |= is_letter[: len(kept) - back]
        if back + 1 in ORDERS:
            spread = mixed ^ (mixed >> np.uint32(15))
            spread = spread * np.uint32(0x85EBCA77)
            bucket = np.where(some, (spread >> np.uint32(16)) % np.uint32(BUCKETS - 1) + 1, 0)
            bucket[starts] = 0
            bucket[starts + 1] = 0
            yield bucket.astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, held = letter_table(), {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (docs, sums) in held.items():
            sums[0] = docs
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())],
                names=["lang", "bucket", "n"],
            )
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list] = {}
        for text, lang in zip(texts, langs):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            if lang not in held and len(held) >= LANGUAGES_PER_BLOCK:
                yield from flush()
            docs, sums = held.get(lang, (0, np.zeros(BUCKETS, np.int64)))
            for _, starts, codes in blocks(own):
                for bucket in hashed(codes, starts, letters):
                    sums += np.bincount(bucket, minlength=BUCKETS)
            sums[0] = 0
            held[lang] = (docs + len(own), sums)
    yield from flush()


@dataclass(frozen=True)
class LanguageModel:
    """Languages in blocks of bounded width; ``weights[b]`` is a broadcast (languages, buckets) matrix."""

    languages: list
    weights: list

    def judge(self, text: Column) -> Column:
        """struct<lang_pred, score> of a text column."""
        if not self.languages:
            return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        parts = [_scorer(langs, w)(text) for langs, w in zip(self.languages, self.weights)]
        best = parts[0] if len(parts) == 1 else F.array_max(F.array(*parts))
        total = sum((F.exp(p["log_sum"] - best["log_p"]) for p in parts), F.lit(0.0))
        known = best["lang"] != UNDETERMINED
        return F.struct(
            best["lang"].alias("lang_pred"),
            F.when(known, F.lit(1.0) / total).otherwise(0.0).alias("score"),
        )


def _scorer(langs: list[str], weights):
    kind = pa.struct([("log_p", pa.float64()), ("rank", pa.int32()), ("log_sum", pa.float64()), ("lang", pa.string())])

    @F.arrow_udf("log_p double, rank int, log_sum double, lang string")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, (matrix, priors, first_rank) = letter_table(), weights.value
        for batch in batches:
            texts = batch.to_pylist()
            sums, any_letter = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
            for rows, starts, codes in blocks(texts):
                lettered = np.add.reduceat(letters[codes].astype(np.int32), starts) > 0
                np.logical_or.at(any_letter, rows, lettered)
                for bucket in hashed(codes, starts, letters):
                    for lang, weight in enumerate(matrix):
                        sums[:, lang] += np.bincount(rows, np.add.reduceat(weight[bucket], starts), len(texts)) / len(ORDERS)
            sums += priors
            best = sums.argmax(axis=1)
            top = sums[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
            log_sum = top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.where(any_letter, top, 0.0)),
                    pa.array((-(best + first_rank)).astype(np.int32)),
                    pa.array(np.where(any_letter, log_sum, 0.0)),
                    pa.array([langs[b] if ok else UNDETERMINED for b, ok in zip(best, any_letter)], pa.string()),
                ],
                fields=list(kind),
            )

    return score


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> LanguageModel:
    """Learn one language model per distinct ``lang`` from every labelled row of ``docs``."""
    spark = docs.sparkSession
    labelled = only(docs, text, lang).filter(F.col(lang).isNotNull())
    partial = labelled.select(F.col(text), F.col(lang).cast("string")).mapInArrow(_counts, "lang string, bucket int, n long")
    sums = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most one row per language and bucket, whatever the size of the corpus
    table = sums.limit(MAX_LANGUAGES * BUCKETS).toArrow()
    names = sorted(set(table.column("lang").unique().to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} fit this model")
    place = {name: i for i, name in enumerate(names)}
    rows = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    buckets, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    docs_of = np.zeros(len(names))
    docs_of[rows[buckets == 0]] = n[buckets == 0]
    languages, weights = [], []
    for first in range(0, len(names), LANGUAGES_PER_BLOCK):
        own = names[first : first + LANGUAGES_PER_BLOCK]
        counts = np.full((BUCKETS, len(own)), smoothing)
        inside = (rows >= first) & (rows < first + len(own)) & (buckets > 0)
        counts[buckets[inside], rows[inside] - first] += n[inside]
        counts[0] = 0
        matrix = np.zeros((len(own), BUCKETS), np.float32)
        matrix[:, 1:] = np.log(counts[1:] / counts.sum(axis=0)).T
        priors = np.log(docs_of[first : first + len(own)] / max(docs_of.sum(), 1))
        languages.append(own)
        weights.append(spark.sparkContext.broadcast((matrix, priors, first)))
    return LanguageModel(languages, weights)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct<lang_pred, score> column."""
    return docs.withColumn(out, model.judge(F.col(text)))


def keep(docs: DataFrame, model: LanguageModel, min_score: float, text: str = "text") -> DataFrame:
    """Documents that some learned language claims with at least ``min_score``; their columns stay as they are."""
    return verdict_filter(
        docs, model.judge, lambda v: (v["lang_pred"] != UNDETERMINED) & (v["score"] >= min_score), text
    )
