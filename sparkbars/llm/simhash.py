"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Two fingerprints link if they differ in at most ``MAX_BITS`` bits. Cut into three parts,
linked fingerprints differ in at most one bit of some part. So the trie is built three
times, each time with another part on top: there a pair of nodes is followed only while
its prefixes differ in at most one bit, and below the part while they differ in at most
four. The pairs of nodes a few levels down are Spark's groups; a pair that holds too many
fingerprints goes down further levels before it becomes a group. Inside a group numpy
traverses the remaining levels, many node pairs at a time.

Defined results: words are separated by ASCII blanks; a text of fewer words than a shingle
is one shingle; a NULL or blank text has fingerprint zero, which links like any other.
Equal fingerprints always link, also among repeated rows. Only distinct fingerprints are
compared, so copies cost nothing beyond their own row. Very long texts are read whole; an empty table gives no rows;
extra columns stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from sparkbars.llm.columns import free_name, quoted
from sparkbars.llm.components import components
from sparkbars.session import cut

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
PARTS = ((0, 21), (21, 21), (42, 22))  # offset and width of the part on top
PART_BITS = MAX_BITS // len(PARTS)
NODE_TARGET = 1024
GROUP_LIMIT = 4096
SPLIT_LEVELS = 4
FRONTIER = 1 << 18
LEAF_PAIRS = 64
HASHES_AT_ONCE = 1 << 18

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def simhash(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(len(words) - SHINGLE_WORDS + 1, 1)
    first, last = start[:n].tolist(), (start + size)[len(words) - n :].tolist()
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        stop = at + HASHES_AT_ONCE
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first[at:stop], last[at:stop])])
        ones += _ones(np.frombuffer(digests, np.uint8))
    return _majority(ones, n)


def simhash_of(digests: np.ndarray) -> int:
    """The same fingerprint of shingles that are hashed already (digests as they stand in memory)."""
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(digests), HASHES_AT_ONCE):
        ones += _ones(digests[at : at + HASHES_AT_ONCE].view(np.uint8))
    return _majority(ones, len(digests))


def _ones(octets: np.ndarray) -> np.ndarray:
    """How many digests have each bit set, by octet."""
    return np.bincount((octets.reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones.ravel() > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprint of a text column; its 64 bits as a signed long."""
    for batch in batches:
        values = np.fromiter((simhash(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.cast(pa.binary())), np.uint64, len(batch))
        yield pa.array(values.view(np.int64))


def _low(bits: int) -> int:
    return (1 << bits) - 1


def _rotated(key: Column, offset: int) -> Column:
    """The key with the part at ``offset`` on top."""
    if offset == 0:
        return key
    return F.shiftleft(key, offset).bitwiseOR(F.shiftrightunsigned(key, 64 - offset))


def _masks(bits: int, most: int) -> list[int]:
    """All patterns of ``bits`` bits with at most ``most`` ones."""
    return [m for m in range(1 << bits) if m.bit_count() <= most] if bits <= 12 else [0, *[1 << i for i in range(bits)]]


def _root_pairs(distinct: DataFrame, levels: int) -> DataFrame:
    """Every fingerprint with each pair of nodes, ``levels`` down, that it takes part in.

    ``a`` and ``b`` are the two prefixes, a <= b; ``side`` says to which of them it belongs.
    """
    parts = []
    for part, (offset, _) in enumerate(PARTS):
        key = _rotated(F.col("fingerprint"), offset)
        prefix = F.shiftrightunsigned(key, 64 - levels) if levels else F.lit(0).cast("long")
        flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(levels)]))
        own = distinct.select(F.lit(part).alias("part"), key.alias("key"), prefix.alias("own"), flips.alias("flip"))
        parts.append(own)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    other = F.col("own").bitwiseXOR(F.col("flip"))
    return rows.select(
        "part", F.lit(levels).alias("depth"), F.least("own", other).alias("a"), F.greatest("own", other).alias("b"),
        (F.col("own") > other).alias("side"), "key",
    )


def _child_pairs(pairs: DataFrame) -> DataFrame:
    """The same fingerprints ``SPLIT_LEVELS`` further down, without node pairs beyond the budget."""
    steps = SPLIT_LEVELS
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in range(1 << steps)]))
    own = F.when(F.col("side"), F.col("b")).otherwise(F.col("a"))
    other = F.when(F.col("side"), F.col("a")).otherwise(F.col("b"))
    grown = F.expr(f"shiftrightunsigned(key, cast(64 - depth - {steps} as int))").bitwiseAND(F.lit(_low(steps)).cast("long"))
    below = pairs.select("part", (F.col("depth") + steps).alias("depth"), own.alias("own"), other.alias("other"),
                         "side", grown.alias("grown"), "key", flips.alias("flip"))
    mine = F.shiftleft("own", steps).bitwiseOR(F.col("grown"))
    theirs = F.shiftleft("other", steps).bitwiseOR(F.col("grown").bitwiseXOR(F.col("flip")))
    lower = below.select("part", "depth", "side", "key", (F.col("own") == F.col("other")).alias("same"),
                         mine.alias("own"), theirs.alias("other"))
    width = F.element_at(F.array(*[F.lit(w) for _, w in PARTS]), F.col("part") + 1)
    differ = F.col("own").bitwiseXOR(F.col("other"))
    top = F.expr("bit_count(shiftrightunsigned(x, cast(greatest(depth - w, 0) as int)))")
    checked = lower.withColumn("x", differ).withColumn("w", width).filter(
        (F.bit_count("x") <= MAX_BITS) & (top <= PART_BITS)
    )
    # below one shared node the smaller child comes first; two nodes keep their sides
    side = F.when(F.col("same"), F.col("own") > F.col("other")).otherwise(F.col("side"))
    return checked.select(
        "part", "depth", F.when(side, F.col("other")).otherwise(F.col("own")).alias("a"),
        F.when(side, F.col("own")).otherwise(F.col("other")).alias("b"), side.alias("side"), "key",
    )


class _Sets:
    """Disjoint sets over positions; the smallest position names a set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def traverse(keys: np.ndarray, sides: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found below one pair of nodes: positions and, for each, the first one of its set.

    ``keys`` are unsigned, ``depth`` bits of them are the node; ``sides`` is all False for a
    node with itself. Node pairs are ranges of the two sorted sides plus the bits that differ.
    """
    order = np.lexsort((keys, sides))
    keys, split = keys[order], int((~sides).sum())
    sets, itself = _Sets(len(keys)), split == len(keys)
    near = np.flatnonzero(np.bitwise_count(keys[1:] ^ keys[:-1]) <= MAX_BITS)
    sets.link(near, near + 1)
    if itself:
        start = np.array([[0, split, 0, split, 0]], np.int64)
    else:
        gap = int(np.bitwise_count((keys[0] ^ keys[-1]) >> np.uint64(64 - depth))) if depth else 0
        start = np.array([[0, split, split, len(keys), gap]], np.int64)
    stack = [(depth, start)]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(level, pairs[half:]), (level, pairs[:half])]
            continue
        pairs = _open(pairs, sets, keys)
        if len(pairs):
            stack.append((level + 1, _children(pairs, keys, level, PART_BITS if level < width else MAX_BITS)))
    return order, order[sets.label]


def _open(pairs: np.ndarray, sets: _Sets, keys: np.ndarray) -> np.ndarray:
    """Compares the fingerprints of small pairs, drops pairs that are one set already, keeps the rest."""
    a0, a1, b0, b1, _ = pairs.T
    work = (a1 - a0) * (b1 - b0)
    small = work <= LEAF_PAIRS
    if small.any():
        own, n = pairs[small], work[small]
        at = np.repeat(np.arange(len(own)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        wide = (own[:, 3] - own[:, 2])[at]
        i, j = own[at, 0] + k // wide, own[at, 2] + k % wide
        linked = np.bitwise_count(keys[i] ^ keys[j]) <= MAX_BITS
        sets.link(i[linked], j[linked])
    pairs = pairs[~small]
    if not len(pairs):
        return pairs
    low, high = _bounds(sets.label, pairs[:, 0], pairs[:, 1]), _bounds(sets.label, pairs[:, 2], pairs[:, 3])
    one = (low[0] == low[1]) & (high[0] == high[1]) & (low[0] == high[0])
    return pairs[~one]


def _bounds(label: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest label of every range."""
    edges, padded = np.stack([start, stop], axis=1).ravel(), np.r_[label, 0]
    return np.minimum.reduceat(padded, edges)[::2], np.maximum.reduceat(padded, edges)[::2]


def _children(pairs: np.ndarray, keys: np.ndarray, level: int, budget: int) -> np.ndarray:
    """Pairs of child nodes one bit further down, within the budget of differing bits."""
    a0, a1, b0, b1, used = pairs.T
    am, bm = _middle(keys, a0, a1, level), _middle(keys, b0, b1, level)
    more = [
        np.stack([a0, am, b0, bm, used], axis=1),
        np.stack([am, a1, bm, b1, used], axis=1),
        np.stack([a0, am, bm, b1, used + 1], axis=1),
        np.stack([am, a1, b0, bm, used + 1], axis=1)[a0 != b0],
    ]
    out = np.concatenate(more)
    return out[(out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3]) & (out[:, 4] <= budget)]


def _middle(keys: np.ndarray, start: np.ndarray, stop: np.ndarray, level: int) -> np.ndarray:
    """First position of every range whose key has a one at ``level``."""
    bit = np.uint64(63 - level)
    ones = np.r_[0, np.cumsum((keys >> bit) & np.uint64(1), dtype=np.int64)]
    return stop - (ones[stop] - ones[start])


def _joined(group: pa.Table) -> pa.Table:
    part, depth = group.column("part")[0].as_py(), group.column("depth")[0].as_py()
    offset, width = PARTS[part]
    keys = group.column("key").to_numpy().view(np.uint64)
    sides = group.column("side").to_numpy().astype(bool)
    at, root = traverse(keys, sides, depth, width)
    moved = at != root
    back = keys if offset == 0 else (keys >> np.uint64(offset)) | (keys << np.uint64(64 - offset))
    return pa.table({"u": back[at[moved]].view(np.int64), "v": back[root[moved]].view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): a forest with the same components as all links between the rows of ``distinct`` (fingerprint)."""
    n = distinct.count()
    levels = min(max(ceil(log2(max(n, 1) / NODE_TARGET)), 0), min(w for _, w in PARTS))
    pair = ["part", "depth", "a", "b"]
    found, waiting = None, cut(_root_pairs(distinct, levels))
    while waiting is not None:
        large = waiting.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_LIMIT)
        large = cut(large.filter(F.col("depth") <= 64 - SPLIT_LEVELS).drop("n"))
        ready = waiting if large.isEmpty() else waiting.join(large, pair, "left_anti")
        linked = cut(ready.groupBy(*pair).applyInArrow(_joined, "u long, v long"))
        found = linked if found is None else found.unionByName(linked)
        waiting = None if large.isEmpty() else cut(_child_pairs(waiting.join(large, pair, "left_semi")))
    return found


def grouped(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """``prints`` with ``first``, the smallest (missing, doc_id, fingerprint) of the row's component.

    ``prints`` should be a written table: it is read three times.
    """
    own = F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("doc_id"),
                   F.col(fingerprint).alias("fingerprint"))
    distinct = cut(prints.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(own).alias("least")))
    roots = components(links(distinct.select("fingerprint")))
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        distinct["fingerprint"].alias("print"), F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    named = cut(named)
    least = cut(named.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "top"))
    named = cut(named.join(least, named["root"] == least["top"]).select("print", "first"))
    return prints.join(named, prints[fingerprint] == named["print"]).select(*[prints[c] for c in prints.columns], "first")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; columns stay as they are.

    Rows that repeat that id with an equal fingerprint count as one document, and one of them
    stays. Documents without an id come last.
    """
    name = free_name(docs, "fingerprint")
    marked = cut(docs.withColumn(name, fingerprint(F.col(quoted(text)))))
    prints = marked.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(name).alias("fingerprint"))
    first = grouped(prints).select("first.*").distinct().select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"))
    first = cut(first)
    kept = marked.join(first, marked[quoted(doc_id)].eqNullSafe(first["_id"]) & (marked[name] == first["_print"]), "left_semi")
    if prints.groupBy("doc_id", "fingerprint").count().filter("count > 1").isEmpty():
        return kept.select(*[F.col(quoted(c)) for c in docs.columns])
    return kept.dropDuplicates([doc_id, name]).select(*[F.col(quoted(c)) for c in docs.columns])
