"""Near-duplicate vectors by product quantisation: inverted lists, subspace codes of residuals, exact rerank.

Vectors of one label link if their cosine, in double precision, is at least ``MIN_COSINE``. Equal vectors
are one entry with a count, so copies cost nothing. Entries lie in the inverted list of their nearest coarse
centre and carry one code per subspace for the residual, with the length of what the codes miss. A vector looks into
lists, estimates distances there from one table per subspace (asymmetric: the vector itself
against codes), and what can be near enough is compared exactly.

Nothing is lost on the way, whatever the codebooks: on the unit sphere the limit is a distance, a list is left out only
if the plane halfway to its centre is farther away than that, and an entry only if its estimate exceeds the limit by
more than its codes miss. So the codebooks, fitted on at most ``SAMPLE_ROWS`` distinct vectors and
``SAMPLE_BYTES`` bytes (the lowest hashes), decide on speed alone; every vector is indexed.

A unit of work is a slice of a list against a slice of the vectors that look into it, both about ``SLICE`` rows, so a label or a
group of near copies of any size is spread out. A unit adds up links per vector and reports a
spanning forest of its links, never the pairs.

Defined results: a vector that is NULL, empty, zero or holds NULL or components that are not finite links with nothing, nor does
one without a label; vectors of different length never link; rows with one id are vectors of their own; a component's id is the
smallest id in it, NULL where there is none; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbars.llm.columns import only
from sparkbars.llm.components import components
from sparkbars.session import cut

MIN_COSINE = 0.93
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
LIST_ROWS = 2048  # of one label in one list, on average
MIN_LISTS, MAX_LISTS = 4, 1024
SUBSPACE, CODES = 8, 256
SLICE = 4096
ROWS_AT_ONCE = 128
ROUNDS = 8
SLACK = 1e-6  # far above rounding, far below any distance that matters
SEED = 13


def unit_rows(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors of unit length in double precision, filled up with zeros, which change no distance."""
    out = np.zeros((len(raw), width))
    for row, value in zip(out, raw):
        x = np.frombuffer(value, np.float64)
        row[: len(x)] = x
    top = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(top > 0, top, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(square, 0)


def centres_of(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from random rows."""
    centres = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(ROUNDS):
        own = distances(x, centres).argmin(axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass(frozen=True)
class Codebooks:
    """Coarse centres, and per subspace the centres of the residuals."""

    coarse: np.ndarray
    fine: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Codebooks:
        rng = np.random.default_rng(SEED)
        coarse = centres_of(x, lists, rng)
        rest = x - coarse[distances(x, coarse).argmin(axis=1)]
        return cls(coarse, [centres_of(rest[:, a : a + SUBSPACE], CODES, rng) for a in range(0, x.shape[1], SUBSPACE)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes miss) of every row."""
        own = distances(x, self.coarse).argmin(axis=1)
        rest = x - self.coarse[own]
        codes, missed = np.zeros((len(x), len(self.fine)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.fine):
            part = rest[:, m * SUBSPACE : (m + 1) * SUBSPACE]
            codes[:, m] = distances(part, book).argmin(axis=1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return own, codes, np.sqrt(missed)

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Which lists may hold a row within ``reach`` of each row: those not beyond the plane halfway to the nearest centre."""
        square = distances(x, self.coarse)
        own = square.argmin(axis=1)
        between = np.sqrt(distances(self.coarse, self.coarse))[own]
        beyond = square - square[np.arange(len(x)), own][:, None]
        return beyond <= 2 * between * reach + SLACK

    def near(self, x: np.ndarray, which: int, codes: np.ndarray, missed: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of x, entry of list ``which``) whose estimated distance does not rule them out, some rows at a time."""
        limit = (reach + missed + SLACK) ** 2
        rest = x - self.coarse[which]
        for a in range(0, len(x), ROWS_AT_ONCE):
            some = rest[a : a + ROWS_AT_ONCE]
            estimate = np.zeros((len(some), len(codes)))
            for m, book in enumerate(self.fine):
                estimate += distances(some[:, m * SUBSPACE : (m + 1) * SUBSPACE], book)[:, codes[:, m]]
            rows, entries = np.nonzero(estimate <= limit)
            yield rows + a, entries


class Forest:
    """Minimum labels of groups that only merge."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return at, self.root[at]


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry key and value of the vectors that can link, NULL for the others."""
    for batch in batches:
        keys, values, dims = [], [], []
        for label, vector in zip(batch["label"].to_pylist(), batch["embedding"]):
            key = value = None
            x = None if label is None or not vector.is_valid or vector.values.null_count else vector.values
            if x is not None and len(x):
                x = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    value = x.tobytes()
                    key = md5(f"{label}:".encode() + value).digest()
            keys.append(key)
            values.append(value)
            dims.append(len(value) // 8 if value else None)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(keys, pa.binary()), batch["label"], pa.array(dims, pa.int32()), pa.array(values, pa.binary())],
            ["vec_id", "key", "label", "dim", "value"],
        )


def _indexed(books: Codebooks, reach: float):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(batch["value"].to_pylist(), books.coarse.shape[1])
            own, codes, missed = books.encode(x)
            probed = books.probes(x, reach)
            arrays = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed),
                      pa.array([np.flatnonzero(p).tolist() for p in probed], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "list", "codes", "missed", "probes"])

    return index


def _unit(books: Codebooks, min_cosine: float, reach: float):
    """Links of the vectors of a unit into its slice of a list: (entry, links, other), ``other`` for the forest."""

    def compare(key, seekers: pa.Table, entries: pa.Table) -> pa.Table:
        out = {"entry": [], "n": [], "other": []}
        if len(seekers) and len(entries):
            width = books.coarse.shape[1]
            x, y = (unit_rows(t["value"].to_pylist(), width) for t in (seekers, entries))
            codes = np.frombuffer(b"".join(entries["codes"].to_pylist()), np.uint8).reshape(len(y), -1)
            a, b = seekers["entry"].to_numpy(), entries["entry"].to_numpy()
            copies, missed = entries["copies"].to_numpy(), entries["missed"].to_numpy()
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            total, forest = np.zeros(len(x), np.int64), Forest(len(names))
            for rows, found in books.near(x, key[1].as_py(), codes, missed, reach):
                rows, found = rows[different := a[rows] != b[found]], found[different]
                for at in range(0, len(rows), 1 << 16):
                    r, f = rows[at : at + (1 << 16)], found[at : at + (1 << 16)]
                    true = np.einsum("ij,ij->i", x[r], y[f]) >= min_cosine
                    np.add.at(total, r[true], copies[f[true]])
                    forest.join(place[r[true]], place[len(a) + f[true]])
            linked = np.flatnonzero(total)
            low, high = forest.edges()
            out = {"entry": np.concatenate([a[linked], names[low]]), "n": np.concatenate([total[linked], np.zeros(len(low), np.int64)]),
                   "other": np.concatenate([a[linked], names[high]])}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return compare


def _slices(count):
    return F.greatest(F.ceil(count / F.lit(SLICE)), F.lit(1)).cast("int")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    named = only(vectors, "vec_id", "label", "embedding")
    kinds = {c: named.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    rows = cut(named.mapInArrow(_readable, f"vec_id {kinds['vec_id']}, key binary, label {kinds['label']}, dim int, value binary"))
    readable = rows.filter("key IS NOT NULL")
    entries = readable.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("value").alias("value"),
    )
    entries = cut(entries.withColumn("entry", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "entry long, n long, other long")
    size = entries.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max("dim")).first()
    if size[0]:
        found = _found(entries, size[0], size[1], kinds["label"], min_cosine)
    links = found.groupBy(F.col("entry").alias("linked")).agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("entry").alias("u"), F.col("other").alias("v")))
    joined = entries.join(roots, F.col("entry") == F.col("node"), "left").join(links, F.col("entry") == F.col("linked"), "left")
    joined = cut(joined.select("key", "copies", "least", F.coalesce("root", "entry").alias("group"), F.coalesce("n", F.lit(0)).alias("n")))
    least = joined.groupBy(F.col("group").alias("its_group")).agg(F.min("least").alias("component_id"))
    told = joined.join(least, F.col("group") == F.col("its_group")).select(
        F.col("key").alias("its_key"), "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    both = rows.select("vec_id", "key").join(told, F.col("key") == F.col("its_key"), "left")
    component = F.when(F.col("its_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _found(entries: DataFrame, largest: int, width: int, label: str, min_cosine: float) -> DataFrame:
    reach = float(np.sqrt(max(2 - 2 * min_cosine, 0)))
    lists = min(max(-(-largest // LIST_ROWS), MIN_LISTS), MAX_LISTS)
    n = max(min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)), lists)
    sample = entries.orderBy(F.xxhash64("key"), "key").limit(n).select("value").toArrow()["value"].to_pylist()
    books = Codebooks.fit(unit_rows(sample, width), lists)
    typed = f"key binary, copies long, least {entries.schema['least'].dataType.simpleString()}, label {label}, dim int, value binary, entry long"
    index = cut(entries.mapInArrow(_indexed(books, reach), f"{typed}, list int, codes binary, missed double, probes array<int>"))
    seekers = index.select("label", "dim", F.explode("probes").alias("list"), "entry", "value")
    # how many rows meet in a list, to cut both sides into slices
    here = index.groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("in_list"))
    there = index.select("label", "dim", F.explode("probes").alias("list")).groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("seeking"))
    sizes = cut(here.join(there, ["label", "dim", "list"]).select("label", "dim", "list", _slices(F.col("in_list")).alias("n_mine"), _slices(F.col("seeking")).alias("n_seek")))
    unit = ["label", "list", "dim", "mine", "seek"]
    salt = F.pmod(F.xxhash64("entry"), F.lit(1 << 30))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = seekers.join(sizes, ["label", "dim", "list"]).withColumn("seek", (salt % F.col("n_seek")).cast("int")).withColumn("mine", each("n_mine"))
    held = index.join(sizes, ["label", "dim", "list"]).withColumn("mine", (salt % F.col("n_mine")).cast("int")).withColumn("seek", each("n_seek"))
    pairs = only(asked, *unit, "entry", "value").groupBy(*unit).cogroup(
        only(held, *unit, "entry", "value", "codes", "missed", "copies").groupBy(*unit))
    return cut(pairs.applyInArrow(_unit(books, min_cosine, reach), "entry long, n long, other long"))
