"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task turns its texts, shard by shard, into word ids and sorts their suffixes by the
first ``WINDOW`` words (packed words, then prefix doubling). Every window of every
benchmark item is then searched in that suffix array by bisection, all windows at once.
Neighbouring windows that match at neighbouring places are one longer verbatim match (``find_matches``).

``find_hits`` and ``remove`` need no places in items: a text gives the spans that matches cover and the digests of the
windows it holds, each once, so its result grows with the text and not with the items that share a window. ``items_of``
finds the items afterwards, by a join of windows for each distinct set of windows.

The benchmark travels to the tasks in blocks of at most ``BLOCK_WORDS`` words (a single
longer item is a block of its own). ``find_hits`` reads the documents once for ``PASS_BLOCKS`` blocks, ``find_matches`` once per block;
the results are carried along. The usual benchmark is one block and one pass, without a shuffle of documents.

Defined results: a NULL text has no words and no matches; an item without a word matches
nothing; an item of fewer words than a window is one window; repeated items count once per
item id; an item without an id marks words but is not listed; repeated rows are judged one
by one; an empty benchmark leaves everything clean; very long texts are searched whole, in a shard of their own; an
empty table gives no rows; extra columns stay, and an operator's column that clashes with one is refused by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from sparkbars.llm.columns import free_name, only, quoted
from sparkbars.session import cut

WINDOW = 10
BLOCK_WORDS = 1 << 19
PASS_BLOCKS = 4
SHARD_WORDS = 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

MATCH = "struct<item: string, item_start: int, start: int, length: int>"
SCHEMA = f"n_words long, matches array<{MATCH}>"
_MATCH_TYPE = pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class TestBlock:
    """Distinct windows of some benchmark items and the places that hold them.

    ``windows`` is (n, WINDOW) of word ids from 1, 0 beyond a short window; window ``w``
    stands at ``places[first[w]:first[w + 1]]``, rows of (item, position in the item).
    """

    vocabulary: dict
    items: list
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    places: np.ndarray
    digests: list


def test_block(items: list[tuple[str | None, list[bytes]]]) -> TestBlock:
    vocabulary: dict[bytes, int] = {}
    rows, places = [], []
    for number, (_, words) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(WINDOW, len(ids))
        for at in range(len(ids) - size + 1):
            rows.append(ids[at : at + size] + [0] * (WINDOW - size))
            places.append((number, at))
    windows, which = np.unique(np.array(rows, np.int64).reshape(-1, WINDOW), axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(len(windows) + 1))
    names = [b"", *vocabulary]
    digests = [xxh3_128_digest(b" ".join([names[i] for i in w if i])) for w in windows.tolist()]
    return TestBlock(vocabulary, [name for name, _ in items], windows, (windows > 0).sum(axis=1),
                     first, np.array(places, np.int64).reshape(-1, 2)[order], digests)


def suffix_array(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Positions of known words, ordered by their next WINDOW words or more; 0 is an unknown word or an end."""
    known = np.flatnonzero(ids)
    bits = max(vocabulary.bit_length(), 1)
    depth = max(min(WINDOW, 62 // bits), 1)
    padded = np.r_[ids, np.zeros(depth, np.int64)]
    key = padded[known]
    for back in range(1, depth):
        key = (key << bits) | padded[known + back]
    order = np.argsort(key)
    rank = np.zeros(len(ids) + 2 * WINDOW, np.int64)
    while depth < WINDOW:
        ordered = key[order]
        rank[known[order]] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]][: len(order)])
        key = rank[known] * (len(known) + 1) + rank[known + depth]
        order, depth = np.argsort(key), depth * 2
    return known[order]


def bisect(ids: np.ndarray, suffixes: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of suffixes that begin with it."""
    padded = np.r_[ids, np.zeros(WINDOW, np.int64)]

    def search(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(block.windows), np.int64), np.full(len(block.windows), len(suffixes))
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            right = _precedes(padded, suffixes[middle], block.windows[open_], block.lengths[open_], after_equal)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    return search(False), search(True)


def _precedes(padded, at, windows, lengths, equal: bool) -> np.ndarray:
    """Whether the suffixes come before the windows, an equal beginning counting as ``equal``."""
    out, undecided = np.full(len(at), equal), np.arange(len(at))
    for step in range(WINDOW):
        undecided = undecided[lengths[undecided] > step]
        here, there = padded[at[undecided] + step], windows[undecided, step]
        out[undecided[here != there]] = (here < there)[here != there]
        undecided = undecided[here == there]
    return out


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) for all values of many ranges."""
    size = stop - start
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def matches(ids: np.ndarray, starts: np.ndarray, block: TestBlock) -> np.ndarray:
    """Maximal verbatim matches of one shard: rows of (text, item, position in the item, in the text, words)."""
    suffixes = suffix_array(ids, len(block.vocabulary))
    low, high = bisect(ids, suffixes, block)
    window, at = _ranges(low, high)
    at = suffixes[at]
    hit, place = _ranges(block.first[window], block.first[window + 1])
    item, item_at = block.places[place].T
    at, length = at[hit], block.lengths[window[hit]]
    order = np.lexsort((at, at - item_at, item))
    item, item_at, at, length = item[order], item_at[order], at[order], length[order]
    follows = np.zeros(len(at), bool)
    follows[1:] = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (item_at[1:] == item_at[:-1] + 1)
    head = np.flatnonzero(~follows)
    run = np.diff(np.r_[head, len(at)])
    text = np.searchsorted(starts, at[head], "right") - 1
    found = np.stack([text, item[head], item_at[head], at[head] - starts[text], length[head] + run - 1], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 1], found[:, 3], found[:, 0]))]


def covered(ids: np.ndarray, starts: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one shard that any match covers, rows of (text, start, words), and (text, window) of the windows that it holds."""
    suffixes = suffix_array(ids, len(block.vocabulary))
    window, at = _ranges(*bisect(ids, suffixes, block))
    at = suffixes[at]
    # a 0 parts the texts, so no span reaches from one into the next
    edge = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + block.lengths[window], minlength=len(ids) + 1)
    inside = np.r_[False, np.cumsum(edge) > 0].astype(np.int8)
    begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    text = np.searchsorted(starts, begin, "right") - 1
    spans = np.stack([text, begin - starts[text], end - begin], axis=1)
    held = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, window], axis=1), axis=0)
    return spans, held


HITS = "n_words long, spans array<struct<start: int, length: int>>, windows array<binary>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("length", pa.int32())])


def _lists(rows: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=count))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _coverer(block):
    @F.arrow_udf(HITS)
    def cover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test: TestBlock = block.value
        names = pa.array(test.digests, pa.binary())
        for batch in batches:
            sizes = np.zeros(len(batch), np.int64)
            spans, held = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
            for rows, starts, ids in _shards(batch.cast(pa.binary()), test.vocabulary, sizes):
                own, windows = covered(ids, starts, test)
                own[:, 0], windows[:, 0] = rows[own[:, 0]], rows[windows[:, 0]]
                spans.append(own)
                held.append(windows)
            found, windows = np.concatenate(spans), np.concatenate(held)
            numbers = [pa.array(found[:, c].astype(np.int32)) for c in (1, 2)]
            yield pa.StructArray.from_arrays([
                pa.array(sizes),
                _lists(found[:, 0], len(batch), pa.StructArray.from_arrays(numbers, fields=list(_SPAN_TYPE))),
                _lists(windows[:, 0], len(batch), names.take(pa.array(windows[:, 1]))),
            ], ["n_words", "spans", "windows"])

    return cover


def _finder(block):
    @F.arrow_udf(SCHEMA)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test: TestBlock = block.value
        for batch in batches:
            sizes, found = np.zeros(len(batch), np.int64), [np.zeros((0, 5), np.int64)]
            for rows, starts, ids in _shards(batch.cast(pa.binary()), test.vocabulary, sizes):
                own = matches(ids, starts, test)
                own[:, 0] = rows[own[:, 0]]
                found.append(own)
            yield _column(np.concatenate(found), sizes, test.items)

    return find


def _shards(texts, vocabulary: dict, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word ids of texts, an unknown word as 0 and a 0 after every text: (rows, starts, ids)."""
    rows, starts, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
        sizes[row] = len(words)
        ids = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            continue
        rows.append(row)
        starts.append(total)
        parts += [ids, np.zeros(1, np.int64)]
        total += len(ids) + 1
        if total >= SHARD_WORDS:
            yield np.array(rows), np.array(starts), np.concatenate(parts)
            rows, starts, parts, total = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), np.concatenate(parts)


def _column(found: np.ndarray, sizes: np.ndarray, items: list) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.bincount(found[:, 0], minlength=len(sizes)))].astype(np.int32)
    names = pa.array(items, pa.string()).take(pa.array(found[:, 1]))
    numbers = [pa.array(found[:, c].astype(np.int32)) for c in (2, 3, 4)]
    rows = pa.StructArray.from_arrays([names, *numbers], fields=list(_MATCH_TYPE))
    return pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["n_words", "matches"])


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[TestBlock]:
    """The benchmark, streamed through the driver one block at a time."""
    items, total = [], 0
    rows = only(benchmark, item_id, text).filter(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text))
    for name, content in rows.toLocalIterator():
        words = words_of(content.encode("utf-8", "surrogatepass"))
        if words:
            if items and total + len(words) > BLOCK_WORDS:
                yield test_block(items)
                items, total = [], 0
            items.append((name, words))
            total += len(words)
    if items:
        yield test_block(items)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", out: str = "contamination") -> DataFrame:
    """``docs`` with a column ``out``: struct<n_words, matches> of every row against every item."""
    spark = docs.sparkSession
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}")
    current, found = docs, 0
    for block in _blocks(benchmark, item_id, item_text):
        judged = _finder(spark.sparkContext.broadcast(block))(F.col(quoted(text)))
        if found:
            new = free_name(current, "block")
            both = F.struct(F.col(f"{new}.n_words").alias("n_words"), F.concat(F.col(f"{out}.matches"), F.col(f"{new}.matches")).alias("matches"))
            current = cut(current).withColumn(new, judged).withColumn(out, both).drop(new)
        else:
            current = current.withColumn(out, judged)
        found += 1
    if not found:
        current = current.withColumn(out, _finder(spark.sparkContext.broadcast(test_block([])))(F.col(quoted(text))))
    return current


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", out: str = "contamination") -> DataFrame:
    """``docs`` with a column ``out``: struct<n_words, spans, windows>, the places that matches cover and the digests of the windows held."""
    spark = docs.sparkSession
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}")
    blocks = _blocks(benchmark, item_id, item_text)
    current, first = docs, True
    while (some := list(islice(blocks, PASS_BLOCKS))) or first:
        judged = [_coverer(spark.sparkContext.broadcast(b))(F.col(quoted(text))) for b in some or [test_block([])]]
        names = [free_name(current, f"block_{i}") for i in range(len(judged))]
        before = current if first else cut(current)
        found = [F.col(n) for n in ([] if first else [out]) + names]
        both = F.struct(
            found[0]["n_words"].alias("n_words"), F.concat(*[f["spans"] for f in found]).alias("spans"),
            F.array_distinct(F.concat(*[f["windows"] for f in found])).alias("windows"),
        )
        current = before.withColumns(dict(zip(names, judged))).withColumn(out, both).drop(*names)
        first = False
    return current


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def windows_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Digests of the distinct windows of an item's text."""
    for batch in batches:
        out = []
        for text in batch.cast(pa.binary()):
            words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
            size = min(WINDOW, len(words))
            out.append(list({xxh3_128_digest(b" ".join(words[k : k + size])) for k in range(len(words) - size + 1)} if words else []))
        yield pa.array(out, pa.list_(pa.binary()))


def signature(windows: Column) -> Column:
    """Equal for equal sets of windows."""
    return F.md5(F.array_join(F.transform(F.array_sort(windows), F.hex), ","))


def items_of(found: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(set, items) for every distinct set of ``windows`` in ``found``: the ids of the items that hold any of them, sorted as text."""
    held = only(benchmark, item_id, item_text).filter(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.explode(windows_of(F.col(item_text))).alias("its_window"))
    sets = found.filter(F.size("windows") > 0).groupBy(signature(F.col("windows")).alias("set")).agg(F.first("windows").alias("windows"))
    each = sets.select("set", F.explode("windows").alias("window"))
    met = each.join(held, F.col("window") == F.col("its_window")).groupBy("set", "item").agg(F.lit(0).alias("any"))
    return met.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))


def hit_words(found: Column, of: str = "matches") -> Column:
    """Words of a text that lie inside any match."""
    spans = F.array_sort(F.transform(found[of], lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("stop"))))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))
    return F.aggregate(
        spans, begin,
        lambda s, m: F.struct(
            (s["n"] + F.greatest(m["stop"] - F.greatest(m["start"], s["stop"]), F.lit(0))).alias("n"),
            F.greatest(s["stop"], m["stop"]).alias("stop"),
        ),
        lambda s: s["n"],
    )


def items_hit(found: Column) -> Column:
    """Ids of the items that a text holds a window of, as sorted strings."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found["matches"], lambda m: m["item"]), lambda i: i.isNotNull())))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without any window of any benchmark item; their columns stay as they are."""
    out = free_name(docs, "contamination")
    found = find_hits(docs, benchmark, text, out=out)
    return found.filter(F.size(F.col(out)["spans"]) == 0).select(*[F.col(quoted(c)) for c in docs.columns])
