"""Quality rules: how much of a text repeats itself, found with a suffix array.

The words of many texts are sorted as one suffix array that never looks past the end of a
text. Neighbours with a long common prefix are occurrences of one repeated passage; a
passage that cannot be prolonged to the left or right without losing an occurrence is a
maximal repeat. A text is kept if it passes the base rules, if maximal repeats of at least
``min_words`` words cover no more than ``max_percent`` of its words, and if none of them is longer than
``max_longest`` words.

Defined results: a NULL or blank text has no words, all its counts are 0 and it fails the
base rule of 50 words. Every row is judged by itself, so repeated rows get equal results.
Memory follows one Arrow batch, or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.llm.columns import verdict_filter
from sparkbars.llm.suffixes import covered, repeats, word_blocks

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
SHORT_WINDOW = 3

COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", repeats array<struct<start: int, length: int>>"


@dataclass(frozen=True)
class RepetitionRules:
    """``min_words``: shortest repeat that counts. The limits are inclusive.

    Published repetition filters let repeats of five words cover 15 % of a text and repeats of ten words
    10 %. Repeats count here with all their occurrences, the first too, so the milder figure holds for ten
    words. The base rule allows 50 % in windows of three words, so a limit near it would decide nothing.
    """

    min_words: int = 10
    max_percent: int = 15
    max_longest: int = 50


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measured(texts: list, min_words: int) -> tuple[dict[str, np.ndarray], list]:
    """Counts per text and its maximal repeats as (row, starts, lengths)."""
    found = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for row, text in enumerate(texts):
        if text:
            found["n_symbols"][row] = len(text) - len(text.translate(None, SYMBOLS))
            found["word_chars"][row] = -(len(text) - len(text.translate(None, BLANKS)))
            found["n_dup_lines"][row] = duplicate_lines(text)
    spans = []
    for rows, starts, ids in word_blocks(text.split() if text else [] for text in texts):
        order, lcp, longest = repeats(starts, ids)
        n, own = len(ids), starts[:-1]
        found["n_words"][rows] = np.diff(starts)
        short = np.flatnonzero(longest >= SHORT_WINDOW)
        found["n_repeat_words"][rows] = np.add.reduceat(covered(short, np.full(len(short), SHORT_WINDOW), n).astype(np.int64), own)
        found["longest_repeat"][rows] = np.maximum.reduceat(longest, own)
        before = np.r_[0, longest[:-1]]
        before[own] = 0
        # prolonged to the left, the passage still occurs as often: it belongs to that repeat
        at = np.flatnonzero((longest >= min_words) & (before != longest + 1))
        found["covered_words"][rows] = np.add.reduceat(covered(at, longest[at], n).astype(np.int64), own)
        if len(at):
            inside = np.searchsorted(starts, at, "right") - 1
            spans.append((np.array(rows)[inside], at - starts[inside], longest[at]))
    return found, spans


def _measure(rules: RepetitionRules):
    @F.arrow_udf(SCHEMA)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, spans = measured(batch.cast(pa.binary()).to_pylist(), rules.min_words)
            chars = pc.fill_null(pc.utf8_length(batch), 0).to_numpy(zero_copy_only=False)
            found["word_chars"] += chars
            row, start, length = (np.concatenate(x) if spans else np.zeros(0, np.int64) for x in (zip(*spans) if spans else ((),) * 3))
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(batch)))].astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], ["start", "length"])
            yield pa.StructArray.from_arrays(
                [*[pa.array(found[c]) for c in COUNTS], pa.ListArray.from_arrays(pa.array(offsets), pairs)], [*COUNTS, "repeats"]
            )

    return measure


def measure(text: Column, rules: RepetitionRules = RepetitionRules()) -> Column:
    """struct of counts and of the maximal repeats (word positions) of a text column."""
    return _measure(rules)(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def kept(m: Column, rules: RepetitionRules = RepetitionRules()) -> Column:
    repetitive = (100 * m["covered_words"] > rules.max_percent * m["n_words"]) | (m["longest_repeat"] > rules.max_longest)
    return ~base_failed(m) & ~repetitive


def keep(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text") -> DataFrame:
    """Documents that pass the base and repetition rules; their columns stay as they are."""
    return verdict_filter(docs, lambda t: measure(t, rules), lambda m: kept(m, rules), text)
