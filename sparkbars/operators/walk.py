"""The path through a table of successors, without reading it in order.

Every node of a key names a later one as its successor. The nodes on the path from the first one are found
in blocks of consecutive nodes: inside a block, the node at which a path leaves it is looked up by pointer
doubling; leaps over 1, 2, 4, ... blocks are then put together by joins, and halved again on the way down, until
every block knows the one node, if any, at which the path enters it. No task sees more than
one block, and a key of any length is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.session import cut

BLOCK_ROWS = 4096
_LONGS = T.ArrayType(T.LongType())


def _flat(steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Successors of all blocks of a batch in one array (-1 for none), and where each block starts."""
    sizes = np.array([len(s) for s in steps], np.int64)
    values = steps.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _leaps(rows: int):
    @F.arrow_udf(_LONGS)
    def leaps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Per node of a block the first node behind the block on its path."""
        for blocks, steps in batches:
            to, starts = _flat(steps)
            sizes = np.diff(starts)
            first = np.repeat(blocks.to_numpy(zero_copy_only=False) * rows, sizes)
            inside = (to >= 0) & (to < first + np.repeat(sizes, sizes))
            # position of the successor in the batch, or of the node itself where the path leaves the block
            at = np.where(inside, to - first + np.repeat(starts[:-1], sizes), np.arange(len(to)))
            while not np.array_equal(at, further := at[at]):
                at = further
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(to[at], pa.int64(), mask=to[at] < 0))

    return leaps


def _walked(rows: int):
    @F.arrow_udf(_LONGS)
    def walked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """The nodes of a block on the path that enters it at a node."""
        for blocks, steps, entered in batches:
            out = []
            for block, successors, node in zip(blocks.to_pylist(), steps, entered.to_pylist()):
                to, first, path = successors.values.fill_null(-1).to_numpy(zero_copy_only=False), block * rows, []
                while first <= node < first + len(to):
                    path.append(node)
                    node = int(to[node - first])
                out.append(path)
            yield pa.array(out, pa.list_(pa.int64()))

    return walked


def _beside(keys: Sequence[str], *on: Column) -> Column:
    """Join condition on the keys, which the right side has under ``_of_`` names."""
    same = F.lit(True)
    for c in [*[F.col(k) == F.col(f"_of_{k}") for k in keys], *on]:
        same = same & c
    return same


def _other(df: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *columns)


def path(nodes: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, index) of the nodes on the path from index 0 of each key.

    ``nodes`` has the keys, ``index`` (0, 1, 2, ... without gaps) and ``next``, the larger index of the successor; NULL or
    an index beyond the last one ends the path.
    """
    keys, rows = list(keys), rows or BLOCK_ROWS
    block_of = F.expr(f"index div {rows}")
    node = F.struct("index", "next")
    blocks = nodes.groupBy(*keys, block_of.alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    blocks = blocks.select(*keys, "block", F.transform("nodes", lambda n: n["next"]).alias("steps"))
    last = (nodes.agg(F.max("index")).first()[0] or 0) // rows
    if not last:  # every key is one block, which the path enters at its first node
        return blocks.select(*keys, F.explode(_walked(rows)("block", "steps", F.lit(0).cast("long"))).alias("index"))
    blocks = cut(blocks)
    starts = blocks.filter("block = 0").select(*keys, F.lit(0).cast("long").alias("index"))
    entries = _entries(blocks, starts, keys, rows, int(last).bit_length())
    right = _other(blocks, keys, F.col("block"), F.col("steps"))
    met = entries.join(right, _beside(keys, block_of == F.col("block")))
    return met.select(*keys, F.explode(_walked(rows)("block", "steps", "index")).alias("index"))


def _entries(blocks: DataFrame, starts: DataFrame, keys: list[str], rows: int, levels: int) -> DataFrame:
    """(keys, index): the node at which the path enters a block, for every block that it enters."""
    leaps = cut(blocks.select(*keys, "block", _leaps(rows)("block", "steps").alias("leaps")))
    landed = leaps.select(*keys, F.explode("leaps").alias("index")).filter("index IS NOT NULL").distinct().unionByName(starts)
    right = _other(leaps, keys, F.col("block"), F.col("leaps"))
    hop = landed.join(right, _beside(keys, F.expr(f"index div {rows}") == F.col("block")))
    # hops[k]: from a node to the first one behind its run of 2**k blocks
    hops = [cut(hop.select(*keys, "index", F.get("leaps", F.col("index") % rows).alias("to")))]
    for level in range(1, levels):
        run = rows << level
        far = _other(hops[-1], keys, F.col("index").alias("at"), F.col("to").alias("on"))
        half = F.expr(f"to div {run} = index div {run}")
        both = hops[-1].join(far, _beside(keys, F.col("to") == F.col("at"), half), "left")
        hops.append(cut(both.select(*keys, "index", F.when(half, F.col("on")).otherwise(F.col("to")).alias("to"))))
    entries = starts
    for level in reversed(range(levels)):
        run = rows << (level + 1)
        hop = _other(hops[level], keys, F.col("index").alias("at"), F.col("to"))
        second = entries.join(hop, _beside(keys, F.col("index") == F.col("at"))).filter(F.expr(f"to div {run} = index div {run}"))
        entries = cut(entries.unionByName(second.select(*keys, F.col("to").alias("index"))))
    return entries
