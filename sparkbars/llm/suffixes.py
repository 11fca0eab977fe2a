"""Suffix arrays over word ids by prefix doubling, in numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np

WORDS_PER_BLOCK = 1 << 18


def word_blocks(texts: Iterator[list], size: int = WORDS_PER_BLOCK) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Word lists gathered into blocks of about ``size`` words: (rows, starts, ids).

    ``starts`` has one entry more than ``rows``; ids are numbered within the block.
    """
    rows, starts, ids, known = [], [0], [], defaultdict(count().__next__)
    for row, words in enumerate(texts):
        if not words:
            continue
        rows.append(row)
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        starts.append(starts[-1] + len(words))
        if starts[-1] >= size:
            yield rows, np.array(starts), np.concatenate(ids)
            rows, starts, ids, known = [], [0], [], defaultdict(count().__next__)
    if rows:
        yield rows, np.array(starts), np.concatenate(ids)


def repeats(starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of every text of a block at once: (order, lcp, longest).

    Suffixes end with their text, so ``order`` has the texts one after the other. ``lcp[i]``
    is the common prefix of the suffixes at ``order[i - 1]`` and ``order[i]``, 0 between
    texts, and ``longest[p]`` the longest passage from word ``p`` that occurs again in its text.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.repeat(starts[1:], np.diff(starts))
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key)
    head = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        size = np.diff(np.r_[np.flatnonzero(head), n])
        tied_at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied_at):
            break
        tied = order[tied_at]
        after = tied + step
        inside = after < end[tied]
        second = np.where(inside, rank[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
        both = rank[tied].astype(np.int64) * (n + 1) + second
        resort = np.argsort(both)
        tied, both = tied[resort], both[resort]
        order[tied_at] = tied
        head[tied_at] = np.r_[True, both[1:] != both[:-1]]
        rank = rank.copy()
        rank[order[tied_at]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[tied_at]
        levels.append(rank)
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp, live = np.zeros(n, np.int64), np.flatnonzero(text[a] == text[b])
    a, b = a[live], b[live]
    for level in range(len(levels) - 1, -1, -1):
        same = np.zeros(len(a), bool)
        at = np.flatnonzero((a < n) & (b < n))
        same[at] = levels[level][a[at]] == levels[level][b[at]]
        lcp[live[same] + 1] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return order, lcp, longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True for every one of ``n`` words inside one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0
