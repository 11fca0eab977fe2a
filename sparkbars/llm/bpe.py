"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges wait in buckets, one per merge rank, that hold positions of a linked list of tokens.
A bitmap in two levels marks the ranks whose bucket holds something, so that find-first-set
gives the next rank whatever the length of the list; entries whose pair has changed
meanwhile are skipped when they come up. A pre-token of n bytes takes about n log n steps,
also one of a million bytes without a blank.

Merges never reach over the end of a pre-token, so many different pre-tokens share one list
and one queue, with a barrier between them: each still sees its own merges in the order of
rank and then of place, and the queue is emptied bucket by bucket instead of once per word.

The ranks are one file of bounded size, read on the driver and broadcast. Each task keeps a
bounded memo of pre-tokens it has seen.

Defined results: a NULL text is encoded as an empty one; ids of no known token make
``decode`` raise; text is never normalised, so decoding gives the bytes back; repeated rows are encoded one by one, an
empty table gives no rows, and very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.llm.pretokens import Splitter

MAX_RANK_FILE = 64 << 20
MEMO_ENTRIES = 200_000
MEMO_CHARS = 256
CHARS_AT_ONCE = 2 << 20
PIECES_AT_ONCE = 1 << 19
MERGED_AT_ONCE = 1 << 15
WORD_BITS = 256
BARRIER = (1 << 24) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as file:
        content = file.read(MAX_RANK_FILE + 1)
    if len(content) > MAX_RANK_FILE:
        raise ValueError(f"{path} has over {MAX_RANK_FILE} bytes")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


class RankQueue:
    """Positions by merge rank, in buckets that a bitmap of two levels finds again."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // WORD_BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        word, bit = divmod(rank, WORD_BITS)
        self.words[word] |= 1 << bit
        self.top |= 1 << word

    def fill(self, ranks: np.ndarray) -> None:
        """Pushes every position at once; -1 is no rank."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, first = np.unique(ranks[order], return_index=True)
        for rank, bucket in zip(found.tolist(), np.split(order, first[1:])):
            self.push(rank, 0)
            self.buckets[rank] = bucket.tolist()

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank that waits, and its positions from left to right."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        first = bits & -bits
        self.words[word] = bits ^ first
        if bits == first:
            self.top ^= 1 << word
        rank = word * WORD_BITS + first.bit_length() - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def pair_ranks(ranks: dict[bytes, int]) -> tuple[dict, dict]:
    """Merge ranks of all pairs of tokens whose bytes together are a token: by left and right id, and by right and left id."""
    by_left: dict[int, dict[int, int]] = {}
    by_right: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                by_left.setdefault(left, {})[right] = rank
                by_right.setdefault(right, {})[left] = rank
    return by_left, by_right


class Encoder:
    """Token ids of texts and back; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], splitter: Splitter):
        self.ranks = ranks
        self.splitter = splitter
        self.by_left, self.by_right = pair_ranks(ranks)
        self.queue = RankQueue(max(ranks.values()))
        self.memo: dict[str, bytes] = {}
        self.large: list[str] = []
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): piece i has the ids from first[i] to first[i + 1]."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size + 1) - size
        whole = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        ids, edge = self.byte_ids[whole], np.zeros(len(whole), bool)
        edge[start - 1], edge[-1] = True, True
        ids[edge] = BARRIER
        pair = np.r_[np.where(edge[:-1] | edge[1:], -1, self.byte_pairs[whole[:-1].astype(np.int64) * 256 + whole[1:]]), -1]
        queue, n = self.queue, len(ids)
        queue.fill(pair)
        ids, pair = ids.tolist(), pair.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, buckets, none = queue.push, queue.buckets, {}
        while queue.top:
            rank, bucket = queue.pop()
            to_right, to_left = self.by_left.get(rank, none).get, self.by_right.get(rank, none).get
            for i, at in enumerate(bucket):
                if pair[at] != rank:
                    continue  # stale: one side has been merged meanwhile
                gone = after[at]
                end = after[gone]
                left = before[at]
                ids[at], ids[gone], pair[gone], after[at], before[end] = rank, -1, -1, end, at
                pair[at] = new = to_right(ids[end], -1)
                if new in buckets:
                    buckets[new].append(at)
                elif new >= 0:
                    push(new, at)
                pair[left] = old = to_left(ids[left], -1)
                if old in buckets:
                    buckets[old].append(left)
                elif old >= 0:
                    push(old, left)
                if 0 <= new < rank or 0 <= old < rank:
                    # a lower rank has come up: it goes first
                    for later in bucket[i + 1 :]:
                        push(rank, later)
                    break
        flat = np.array(ids, np.int64)
        alive = (flat >= 0) & (flat != BARRIER)
        first = np.r_[0, np.cumsum(alive)][np.r_[start, n]]
        return flat[alive], first

    def learn(self, pieces: set) -> None:
        """Puts the ids of all these pre-tokens into the memo."""
        memo = self.memo
        missing = [p for p in pieces if p not in memo]
        for p in self.large:  # a pre-token of a megabyte isn't worth its place
            if p not in pieces:
                memo.pop(p, None)
        self.large = [p for p in pieces if len(p) > MEMO_CHARS]
        if len(memo) + len(missing) > MEMO_ENTRIES:
            self.memo = memo = {p: memo[p] for p in pieces if p in memo}
        spelled = [p.encode("utf-8", "surrogatepass") for p in missing]
        known = [self.ranks.get(b) for b in spelled]
        for piece, rank in zip(missing, known):
            if rank is not None:
                memo[piece] = rank.to_bytes(4, "little")
        rest = [i for i, rank in enumerate(known) if rank is None]
        for at in range(0, len(rest), MERGED_AT_ONCE):
            own = rest[at : at + MERGED_AT_ONCE]
            ids, first = self.merge([spelled[i] for i in own])
            packed, first = ids.astype("<u4").tobytes(), (4 * first).tolist()
            for i, a, b in zip(own, first, first[1:]):
                memo[missing[i]] = packed[a:b]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; a few texts are held at a time."""
        lists, chars = [], 0
        for text in texts:
            if lists and chars + len(text) > CHARS_AT_ONCE:
                yield from self.known(lists)
                lists, chars = [], 0
            if len(text) > CHARS_AT_ONCE:
                yield b"".join(x for pieces in self.splitter.stretches(text, PIECES_AT_ONCE) for x in self.known([pieces]))
            else:
                lists.append(self.splitter.split(text))
                chars += len(text)
        yield from self.known(lists)

    def known(self, lists: list[list[str]]) -> Iterator[bytes]:
        self.learn(set(chain.from_iterable(lists)))
        look = self.memo.__getitem__
        for pieces in lists:
            yield b"".join(map(look, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tiktoken_class(ranks: dict[bytes, int]):
    """Asks tiktoken for the class of a character."""
    import tiktoken

    bytes_only = {bytes([b]): b for b in range(256)}
    asked = {
        name: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        for name, pattern in (("S", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))
    }
    return lambda char: next((name for name, e in asked.items() if e.encode_ordinary(char)), "O")


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    return Encoder(ranks, Splitter(pattern, tiktoken_class(ranks)))


def texts_of(batch: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in batch)


class Tokenizer:
    """Columns of token ids by a broadcast rank file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

    def encode(self, text: Column) -> Column:
        """Ids of a text column as binary: little-endian unsigned 32-bit integers."""
        shared = self.shared

        @F.arrow_udf(T.BinaryType())
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder(*shared.value)
            for batch in batches:
                yield pa.array(list(own.encode(texts_of(batch))), pa.binary())

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of an id column; NULL stays NULL."""
        shared = self.shared

        @F.arrow_udf(T.BinaryType())
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder(*shared.value)
            for batch in batches:
                yield pa.array([own.decode(t.as_py()) if t.is_valid else None for t in batch], pa.binary())

        return decode(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<n_tokens, ids, round_trip>: ids of every text, and whether decoding them gives its bytes back."""
        shared = self.shared
        names = ["n_tokens", "ids", "round_trip"]
        kind = T.StructType().add(names[0], T.LongType()).add(names[1], T.BinaryType()).add(names[2], T.BooleanType())

        @F.arrow_udf(kind)
        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder(*shared.value)
            for batch in batches:
                ids, same = [], []
                for content, found in zip(batch.cast(pa.binary()), own.encode(texts_of(batch))):
                    ids.append(found)
                    same.append(own.decode(found) == (content.as_py() or b""))
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.StructArray.from_arrays([sizes, pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names)

        return round_trip(text)

    def digest(self, text: Column) -> Column:
        """struct<n_tokens, ids_sha256, decoded_sha256>: a round trip of every text, without keeping the ids."""
        shared = self.shared
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        kind = T.StructType().add(names[0], T.LongType()).add(names[1], T.StringType()).add(names[2], T.StringType())

        @F.arrow_udf(kind)
        def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder(*shared.value)
            for batch in batches:
                rows = [
                    (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
                    for ids in own.encode(texts_of(batch))
                ]
                columns = zip(*rows) if rows else ((), (), ())
                types = (pa.int64(), pa.string(), pa.string())
                yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

        return digest(text)
