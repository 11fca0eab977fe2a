"""Token counts of whole texts, huge ones by overlapping chunks that are spliced together.

A text of at most ``CHUNK_CHARS`` characters is encoded at once. A longer one is encoded in
chunks that overlap, with the offsets of the pre-tokens. The pattern that finds pre-tokens
reads from left to right and looks no more than ``margin`` characters ahead of a boundary,
so a boundary of the left chunk that ends ``margin`` characters or more before the chunk
does is a boundary of the whole text, given that the chunk began at one. If the right
chunk has the same boundary, both read on from there alike: tokens of the left chunk count
up to it, tokens of the right one from it. If no boundary of the overlap is common, the
overlap is doubled, at last up to the place where the left chunk began, which is a boundary
by itself.

The tokenizer library counts the tokens of every distinct pre-token; each task keeps a
bounded memo. The tokenizer file has a bounded size, is read on the driver and broadcast.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; strings of special tokens
inside a text count as that one token, as the library does by default; repeated rows are
counted one by one; an empty table gives no rows; extra columns stay, whatever they are called.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.llm.pretokens import STAND_IN, Splitter

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 64
CHARS_AT_ONCE = 4 << 20
MEMO_ENTRIES = 200_000
MEMO_CHARS = 256
MAX_FILE = 64 << 20
LOOKAHEAD = 3  # characters: the longest contraction, an apostrophe and two letters


def library_class(pre_tokenizer):
    """Asks the library for the class of a character: what it sticks to, it is."""

    def of(char: str) -> str:
        together = [name for name in ("L", "N", "O") if len(pre_tokenizer.pre_tokenize_str(STAND_IN[name] + char)) == 1]
        return together[0] if together else "S"

    return of


class Counter:
    """Counts tokens as the library does for a byte-level tokenizer file."""

    def __init__(self, content: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(content)
        kind = parts["pre_tokenizer"] or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        if not plain or parts["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
            raise ValueError("only byte-level tokenizers without normaliser and with plain special tokens")
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter = Splitter(pattern, library_class(self.library.pre_tokenizer))
        special = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.margin = max([LOOKAHEAD, *map(len, special)])
        self.memo: dict[str, int] = {}
        self.large: list[str] = []

    def pieces(self, text: str) -> list[str]:
        """Special tokens and pre-tokens; together they are the text."""
        if not any(s in text for s in self.special):
            return self.splitter.split(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.splitter.split(part) if part else []
        return out

    def learn(self, pieces: set) -> None:
        memo = self.memo
        missing = [p for p in pieces if p not in memo]
        for p in self.large:  # a pre-token of a megabyte isn't worth its place
            if p not in pieces:
                memo.pop(p, None)
        self.large = [p for p in pieces if len(p) > MEMO_CHARS]
        if len(memo) + len(missing) > MEMO_ENTRIES:
            self.memo = memo = {p: memo[p] for p in pieces if p in memo}
        if missing:
            found = self.library.encode_batch_fast(missing, add_special_tokens=False)
            memo.update(zip(missing, map(len, found)))

    def spliced(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
        """(tokens, chunks, widenings) of one text, read in overlapping chunks."""
        total, chunks, widened = 0, 1, 0
        start, ends, sums = 0, *self.scan(text[:chunk])
        stop = min(chunk, len(text))
        while stop < len(text):
            # boundaries of the left chunk that hold for the whole text, its own start included
            proven = np.r_[0, ends[ends <= stop - start - self.margin]] + start
            wide, right_stop = overlap, min(stop + chunk, len(text))
            while True:
                right = max(stop - self.margin - wide, start)
                right_ends, right_sums = self.scan(text[right:right_stop])
                # where the left chunk begins, the right one begins at a boundary too
                own_ends = right_ends if right > start else np.r_[0, right_ends]
                common = np.intersect1d(proven, own_ends + right)
                if len(common):
                    break
                wide, widened = 2 * wide, widened + 1
            at = int(common[-1])
            total += int(np.r_[0, sums][np.searchsorted(ends, at - start, "right")])
            # the right chunk goes on from the common boundary
            skip = int(np.searchsorted(right_ends, at - right, "right"))
            base = int(np.r_[0, right_sums][skip])
            start, ends, sums, stop = at, right_ends[skip:] + right - at, right_sums[skip:] - base, right_stop
            chunks += 1
        return total + (int(sums[-1]) if len(sums) else 0), chunks, widened

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pre-tokens and tokens up to each of them."""
        pieces = self.pieces(text)
        self.learn(set(pieces))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return ends, np.cumsum(np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces)))

    def counts(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(tokens, chunks, widenings) of every text."""
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > CHUNK_CHARS:
                out.append(self.spliced(texts[at]))
                at += 1
                continue
            lists, chars = [], 0
            while at < len(texts) and len(texts[at]) <= CHUNK_CHARS and chars < CHARS_AT_ONCE:
                lists.append(self.pieces(texts[at]))
                chars += len(texts[at])
                at += 1
            self.learn(set(chain.from_iterable(lists)))
            out += [(sum(map(self.memo.__getitem__, pieces)), 1, 0) for pieces in lists]
        return out


class TokenCounter:
    """Columns of token counts by a broadcast tokenizer file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            content = file.read(MAX_FILE + 1)
        if len(content) > MAX_FILE:
            raise ValueError(f"{path} has over {MAX_FILE} characters")
        Counter(content, pattern)
        self.shared = spark.sparkContext.broadcast((content, pattern))

    def count(self, text: Column) -> Column:
        """struct<n_tokens, n_chunks, n_widened> of a text column."""
        shared = self.shared
        names = ["n_tokens", "n_chunks", "n_widened"]

        @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Counter(*shared.value)
            for batch in batches:
                found = np.array(own.counts([t or "" for t in batch.to_pylist()]), np.int64).reshape(-1, 3)
                yield pa.StructArray.from_arrays([pa.array(c) for c in found.T], names)

        return count(text)
