"""Near copies by SimHash fingerprints, linked by the trie self-join, and by MinHash bands for what lies beyond its budget.

Two texts link if their sets of five-word shingles have an exact Jaccard similarity of at least ``MIN_SIMILARITY``;
groups are the connected components of the links. Every distinct text has a fingerprint of its shingles. The trie join
(see ``simhash``) links the fingerprints that differ in few bits; what it links is compared on the whole texts, and what holds makes
the first groups.

At a similarity of 0.8 fingerprints differ in about 10 bits, more than a trie can prune. So every distinct text also
has a sketch of ``BANDS * ROWS`` minima, and texts that
agree in the first ``KEY_ROWS`` minima of a band share a bucket. A pair counts in the first band it shares, and only if
the sketches agree in ``MIN_ESTIMATE`` of their minima; such candidates between different first groups are compared on their whole texts.
A pair of similarity 0.8 shares a bucket with a chance of 0.9996, and then falls below the estimate with less than 0.0001.

Buckets of up to ``FEW`` texts give all their pairs. Larger ones are cut into slices of ``SLICE`` texts, each with
the first text of the bucket beside them. First a slice gives a spanning forest of its candidates. Then,
with the groups known that these make, the texts that are not in the first text's group are held against
every slice, and all candidates between different groups are compared there, until the groups are one. So copies of one text cost
a pair each, however many there are, no link between groups is left out, and no pairs but links leave a task.

Sketches travel, texts don't: only texts of candidates are read again, once per round, and documents are
told apart by id and digest of the text.

Defined results: words are separated by ASCII blanks and compared without ASCII case; a text
of fewer words than a shingle is one shingle; NULL and blank texts are one text. Equal word
sequences are one text (128 hash bits) and are never compared. Very long texts are read whole, in blocks of
shingles. An empty table stays empty; extra columns stay as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_digest

from sparkbars.llm import simhash
from sparkbars.llm.columns import free_name, only, quoted
from sparkbars.llm.components import components
from sparkbars.session import cut, release

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS, KEY_ROWS = 20, 7, 5
MINIMUM_BYTES = 2  # of each minimum
# four standard deviations of the estimate below the limit
MIN_ESTIMATE = MIN_SIMILARITY - 4 * (MIN_SIMILARITY * (1 - MIN_SIMILARITY) / (BANDS * ROWS)) ** 0.5
FEW = 16
SLICE = 1024
SEED = 42
SHINGLES_AT_ONCE = 1 << 12
BROADCAST_ROWS = 1 << 18  # keys of 40 bytes: 10 MB

_RANDOM = np.random.default_rng(SEED)
_MASK = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_FACTOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(len(words) - SHINGLE_WORDS + 1, 1)
    first, last = start[:n].tolist(), (start + size)[len(words) - n :].tolist()
    return np.unique(np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first, last)]), np.uint64))


def minima(hashes: np.ndarray) -> bytes | None:
    """Two bytes of the least hash under each permutation, band by band; None for a text without words."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        np.minimum(least, ((hashes[at : at + SHINGLES_AT_ONCE] ^ _MASK) * _FACTOR).min(axis=1), out=least)
    # the least of many has small top bits, so two bytes of a product tell minima apart
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2").tobytes()


SKETCH = T.StructType([
    T.StructField("print", T.BinaryType()), T.StructField("fingerprint", T.LongType()), T.StructField("mins", T.BinaryType()),
])


@F.arrow_udf(SKETCH)
def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Digest of the words of a text column, the fingerprint of its shingles (64 bits as a signed long) and their minima."""
    for batch in batches:
        prints, bits, mins = [], [], []
        for text in batch.cast(pa.binary()):
            words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
            prints.append(xxh3_128_digest(b" ".join(words)))
            hashes = shingles(words)
            bits.append(simhash.simhash_of(hashes))
            mins.append(minima(hashes))
        signed = pa.array(np.array(bits, np.uint64).view(np.int64))
        yield pa.StructArray.from_arrays([pa.array(prints, pa.binary()), signed, pa.array(mins, pa.binary())], SKETCH.names)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


@F.arrow_udf(T.BooleanType())
def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether two text columns reach ``MIN_SIMILARITY``."""
    known, hashes = None, np.zeros(0, np.uint64)
    for own, other in batches:
        found = []
        for a, b in zip(own.cast(pa.binary()).to_pylist(), other.cast(pa.binary()).to_pylist()):
            if b != known:
                known, hashes = b, shingles(words_of(b))
            found.append(similarity(shingles(words_of(a)), hashes) >= MIN_SIMILARITY)
        yield pa.array(found, pa.bool_())


def _sketches(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(-1, BANDS, ROWS)


def candidates(a: np.ndarray, b: np.ndarray, band: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimate of each pair of rows and whether it is a candidate of its band: the first one that both share."""
    same = a == b
    shared = same[..., :KEY_ROWS].all(axis=-1)
    estimate = same.mean(axis=(-2, -1))
    return estimate, shared.any(axis=-1) & (shared.argmax(axis=-1) == band) & (estimate >= MIN_ESTIMATE)


@F.arrow_udf(T.BooleanType())
def promising(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Whether two sketches may belong to similar texts."""
    for a, b in batches:
        same = _sketches(a.to_pylist()) == _sketches(b.to_pylist())
        yield pa.array(same.mean(axis=(1, 2)) >= MIN_ESTIMATE, pa.bool_())


PAIRS = "u long, v long"


def _pairs(u: list, v: list) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _forest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Edges of a spanning forest, of the highest estimates, over the candidates of a slice."""
    rows, band = table["row"].to_numpy(), table["band"][0].as_py()
    rows, first = np.unique(rows, return_index=True)
    sketches = _sketches(table["mins"].to_pylist())[first]
    n = len(rows)
    best, parent, out = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    u, v = [], []
    for _ in range(n):
        k = int(np.where(out, best, -2.0).argmax())
        if best[k] > 0:
            u.append(int(rows[k]))
            v.append(int(rows[parent[k]]))
        out[k] = False
        open_ = np.flatnonzero(out)
        estimate, wanted = candidates(sketches[open_], sketches[k], band)
        better = open_[wanted & (estimate > best[open_])]
        best[better], parent[better] = estimate[wanted & (estimate > best[open_])], k
    return _pairs(u, v)


def _between(key, mine: pa.Table, other: pa.Table) -> pa.Table:
    """Links that join groups: candidates between rows of one side and rows of other groups, compared on their whole texts.

    The likeliest come first, and pairs of groups that are joined meanwhile are not compared any more.
    """
    u, v = [], []
    if len(mine) and len(other):
        sketches, band = _sketches(other["mins"].to_pylist()), other["band"][0].as_py()
        group, own_group = other["group"].to_numpy(), mine["group"].to_pylist()
        pairs = [np.zeros((0, 3))]
        for i, own in enumerate(_sketches(mine["mins"].to_pylist())):
            estimate, wanted = candidates(sketches, own, band)
            found = np.flatnonzero(wanted & (group != own_group[i]))
            pairs.append(np.stack([np.full(len(found), i), found, estimate[found]], axis=1))
        pairs = np.concatenate(pairs)
        rows = (mine["row"].to_pylist(), other["row"].to_pylist())
        texts = (mine["words"].cast(pa.binary()), other["words"].cast(pa.binary()))
        sets: dict[tuple[int, int], np.ndarray] = {}
        joined: dict[int, int] = {}

        def set_of(side: int, at: int) -> np.ndarray:
            if (side, at) not in sets:
                sets[side, at] = shingles(words_of(texts[side][at].as_py()))
            return sets[side, at]

        def root(g: int) -> int:
            while joined.get(g, g) != g:
                g = joined[g]
            return g

        for i, j in pairs[np.argsort(-pairs[:, 2], kind="stable"), :2].astype(np.int64).tolist():
            a, b = root(own_group[i]), root(int(group[j]))
            if a != b and similarity(set_of(0, i), set_of(1, j)) >= MIN_SIMILARITY:
                joined[max(a, b)] = min(a, b)
                u.append(max(rows[0][i], rows[1][j]))
                v.append(min(rows[0][i], rows[1][j]))
    return _pairs(u, v)


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(u, v) of the rows whose fingerprints the trie join links.

    Rows of one fingerprint stand beside the first of them, and the first ones of linked fingerprints beside each other.
    """
    rows = distinct.filter("mins IS NOT NULL")
    prints = rows.groupBy(F.col("fingerprint").alias("bits")).agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n"))
    prints = cut(prints)
    mine, other = (prints.select(F.col("bits").alias(f"bits_{s}"), F.col("low").alias(f"low_{s}")) for s in "uv")
    found = simhash.links(prints.select(F.col("bits").alias("fingerprint")))
    found = found.join(mine.hint("merge"), F.col("u") == F.col("bits_u")).join(other.hint("merge"), F.col("v") == F.col("bits_v"))
    found = found.select(F.greatest("low_u", "low_v").alias("u"), F.least("low_u", "low_v").alias("v"))
    equal = rows.join(prints.filter("n > 1").hint("merge"), F.col("fingerprint") == F.col("bits")).filter("row > low")
    pairs = cut(found.unionByName(equal.select(F.col("row").alias("u"), F.col("low").alias("v"))).distinct())
    release(prints)
    return pairs


def _between_groups(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) whose rows are not in one group of ``known``."""
    mine, other = (known.select(F.col("its_row").alias(f"row_{s}"), F.col("root").alias(f"root_{s}")) for s in "uv")
    named = pairs.join(mine.hint("merge"), F.col("u") == F.col("row_u"), "left").join(other.hint("merge"), F.col("v") == F.col("row_v"), "left")
    return named.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def _buckets(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, band, key) of texts that share buckets, and (bucket, n, low, high) of these buckets."""
    width = MINIMUM_BYTES * ROWS
    keys = F.array(*[
        F.struct(F.lit(band).alias("band"), F.xxhash64(F.lit(band), F.substring("mins", width * band + 1, MINIMUM_BYTES * KEY_ROWS)).alias("key"))
        for band in range(BANDS)
    ])
    members = distinct.filter("mins IS NOT NULL").select("row", F.explode(keys).alias("b")).select("row", "b.*")
    sizes = members.groupBy(F.col("key").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
    sizes = cut(sizes.filter("n > 1"))
    # texts in buckets of two are known from the sizes
    return members.join(sizes.filter("n > 2").hint("merge"), F.col("key") == F.col("bucket")).select("row", "band", "key", "n", "low"), sizes


def _beside_sketches(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    mine, other = (distinct.select(F.col("row").alias(f"row_{s}"), F.col("mins").alias(f"mins_{s}")) for s in "uv")
    return pairs.join(mine.hint("merge"), F.col("u") == F.col("row_u")).join(other.hint("merge"), F.col("v") == F.col("row_v"))


def _texts(wanted: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, words) of the rows ``wanted`` (node), read from the documents again."""
    keys = distinct.join(wanted.hint("merge"), F.col("row") == F.col("node"))
    keys = cut(keys.select("row", F.col("own.doc_id").alias("its_id"), F.col("own.body").alias("its_body")))
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), _body(text).alias("body"), F.col(quoted(text)).alias("words"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("body") == F.col("its_body"))
    texts = cut(rows.join(_small(keys), same).groupBy("row").agg(F.first("words").alias("words")))
    release(keys)
    return texts


def _links(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(u, v) of the pairs whose whole texts are similar."""
    pairs = cut(pairs)
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), distinct, docs, doc_id, text)
    # a text that stands beside many is dealt to several tasks
    deals = cut(pairs.groupBy(F.col("v").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("deals")))
    own = texts.select(F.col("row").alias("u"), F.col("words").alias("own"))
    other = texts.join(deals.hint("merge"), F.col("row") == F.col("hub")).select(
        F.col("row").alias("v"), F.explode(F.expr("sequence(0L, deals - 1)")).alias("deal"), F.col("words").alias("other"))
    dealt = pairs.join(deals.hint("merge"), F.col("v") == F.col("hub")).select("u", "v", F.pmod(F.xxhash64("u"), "deals").alias("deal"))
    met = dealt.join(own.hint("merge"), "u").join(other.hint("merge"), ["v", "deal"]).sortWithinPartitions("v")
    found = cut(met.filter(similar(F.col("own"), F.col("other"))).select("u", "v"))
    release(pairs, texts, deals)
    return found


def _small(keys: DataFrame) -> DataFrame:
    """Sends keys around if they are few, by their count; a merge join takes more."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")


def _body(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))))


def _grouped(links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("its_row"), "root")
    return cut(found.unionByName(found.select(F.col("root").alias("its_row"), "root").distinct()))


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, print, mins): a document, told apart by id and digest of the text, and the sketch of its words."""
    own = F.struct(F.col("id").isNull().alias("missing"), F.col("id").alias("doc_id"), F.col("body"))
    drawn = docs.select(F.col(quoted(doc_id)).alias("id"), _body(text).alias("body"), sketch(F.col(quoted(text))).alias("s"))
    return drawn.select(own.alias("own"), "s.*")


def groups(distinct: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(its_row, root) of the rows of ``distinct`` (row, own, fingerprint, mins) that have near copies; texts are read from ``docs``."""
    linked = _fingerprint_pairs(distinct)
    first_links = _links(linked, distinct, docs, doc_id, text)
    first_groups = _grouped(first_links)
    members, sizes = _buckets(distinct)
    members = cut(members)
    two = sizes.filter("n = 2").select(F.col("high").alias("u"), F.col("low").alias("v"))
    few = members.filter(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    few = few.select(F.explode(F.expr("flatten(transform(rows, (v, i) -> transform(slice(rows, i + 2, size(rows)), u -> struct(u, v))))")).alias("p"))
    pairs = cut(two.unionByName(few.select("p.u", "p.v")).distinct())
    near = _beside_sketches(pairs, distinct).filter(promising(F.col("mins_u"), F.col("mins_v"))).select("u", "v")
    # a large bucket: its slices, each with the first text of all
    large = members.filter(F.col("n") > FEW)
    slices = F.ceil(F.col("n") / SLICE)
    sliced = cut(large.select("row", "band", "key", "low", slices.alias("slices"), F.pmod(F.xxhash64("row"), slices).alias("slice")).join(
        distinct.select(F.col("row").alias("its_row"), "mins").hint("merge"), F.col("row") == F.col("its_row")).drop("its_row"))
    first = sliced.filter("row = low").withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
    forest = sliced.unionByName(first).select("row", "band", "key", "slice", "mins").groupBy("key", "slice").applyInArrow(_forest, PAIRS)
    beyond = _between_groups(near.unionByName(forest).distinct(), first_groups)
    more_links = _links(beyond, distinct, docs, doc_id, text)
    links = first_links.unionByName(more_links)
    known = _grouped(links)
    # what the first text's group does not hold yet meets the whole bucket
    grouped = cut(sliced.join(known.hint("merge"), F.col("row") == F.col("its_row"), "left").withColumn(
        "group", F.coalesce("root", "row")).drop("its_row", "root"))
    main = grouped.filter("row = low").select(F.col("key").alias("its_key"), F.col("group").alias("main"))
    apart = grouped.join(main.hint("merge"), F.col("key") == F.col("its_key")).filter("group <> main").drop("its_key", "main")
    counts = cut(apart.groupBy(F.col("key").alias("its_key")).agg(F.count(F.lit(1)).alias("apart")))
    if not counts.isEmpty():
        mixed = grouped.join(counts.select(F.col("its_key").alias("mixed")).hint("merge"), F.col("key") == F.col("mixed"), "left_semi")
        texts = _texts(mixed.select(F.col("row").alias("node")).distinct(), distinct, docs, doc_id, text)
        more = cut(_across(apart, mixed, counts, texts.withColumnRenamed("row", "its_row")))
        all_links = cut(links.unionByName(more).distinct())
        release(known, texts, more)
        known = _grouped(all_links)
        release(all_links)
    release(linked, first_links, first_groups, members, sizes, pairs, sliced, grouped, counts, more_links)
    return known


def _across(apart: DataFrame, all_rows: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links of rows apart from their bucket's first group with all rows of the bucket, slice by slice."""
    parts = F.ceil(F.col("apart") / SLICE)
    unit = ["key", "mine", "slice"]

    def dealt(rows: DataFrame) -> DataFrame:
        read = rows.join(texts.hint("merge"), F.col("row") == F.col("its_row")).drop("its_row")
        return read.join(counts, F.col("key") == F.col("its_key"))

    left = dealt(apart).withColumn("mine", F.pmod(F.xxhash64("row"), parts)).withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
    right = dealt(all_rows).withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    left, right = (only(df, *unit, "row", "band", "mins", "group", "words") for df in (left, right))
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_between, PAIRS)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; columns stay as they are.

    Rows that repeat that id with equal texts count as one document, and one of them stays.
    Documents without an id come last.
    """
    drawn = cut(sketched(docs, doc_id, text))
    texts = drawn.groupBy("print").agg(F.min("own").alias("own"), F.first("fingerprint").alias("fingerprint"), F.first("mins").alias("mins"), F.count(F.lit(1)).alias("copies"))
    distinct = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    known = groups(distinct, docs, doc_id, text)
    named = distinct.select("print", "own", "copies", "row").join(known.hint("merge"), F.col("row") == F.col("its_row"), "left")
    named = cut(named.filter("copies > 1 OR root IS NOT NULL").select(F.col("print").alias("its_print"), "own", F.coalesce("root", "row").alias("group")))
    winners = named.groupBy(F.col("group").alias("its_group")).agg(F.min("own").alias("winner"))
    told = named.join(winners, F.col("group") == F.col("its_group")).select("its_print", "winner")
    judged = drawn.select("own", "print").join(told.hint("merge"), F.col("print") == F.col("its_print"))
    judged = cut(judged.groupBy("own").agg((F.first("own") != F.first("winner")).alias("lost"), F.count(F.lit(1)).alias("n")).select("own.doc_id", "own.body", "lost", "n"))
    release(drawn, distinct, known, named)
    mark, its_id, its_body = (free_name(docs, n) for n in ("body", "its_id", "its_body"))
    rows = docs.withColumn(mark, _body(text))
    same = F.col(quoted(doc_id)).eqNullSafe(F.col(its_id)) & (F.col(mark) == F.col(its_body))

    def keys(which: str) -> DataFrame:
        return _small(judged.filter(which).select(F.col("doc_id").alias(its_id), F.col("body").alias(its_body)))

    rows = rows.join(keys("lost"), same, "left_anti")
    if not judged.filter("n > 1 AND NOT lost").isEmpty():
        again = rows.join(keys("n > 1 AND NOT lost"), same, "left_semi").dropDuplicates([doc_id, mark])
        rows = rows.join(keys("n > 1 AND NOT lost"), same, "left_anti").unionByName(again)
    return rows.select(*[F.col(quoted(c)) for c in docs.columns])
