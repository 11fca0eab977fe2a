"""Merkle manifest of a table: a tree of digests per group, with a persistent version per changed leaf.

Leaves are the digests of rows. Per group they ascend by id, and every ``ARITY`` neighbours
become the digest of their digests until one is left, the group's subroot; a last run may be
shorter, down to a single node that is hashed alone. Subroots in the order of their groups give the root
in the same way.

A tree is built in aligned blocks of ``BLOCK`` leaves, one Spark group each; the blocks' roots are the
leaves of the next round, so a round has a thousandth of the rows of the one before it and no task ever
holds more than a block. Inside a block, nodes are kept in a pool that is only added to: a changed leaf
adds its own node and copies of its ancestors, which point to the untouched nodes of the first version,
so a version costs one node per level. Above the block a version goes on with the siblings of its block.

Defined results: rows with equal group and id are ordered by their digests, so equal rows are
interchangeable; NULL ids and NULL groups come first and are leaves like others; an empty or very long text
is a text (rows are hashed by Spark, whole); an empty table has no tree and gives no rows; other
columns than the ones named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbars.llm.columns import only, quoted
from sparkbars.llm.ordering import places
from sparkbars.session import cut

ARITY = 2
LEVELS = 10  # of a block
BLOCK = ARITY**LEVELS
LONE, LEFT, RIGHT = b"\0", b"\1", b"\2"  # side of the sibling that follows


def digest(*parts: bytes) -> bytes:
    """Digest of digests, all as hexadecimal text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` for NULL, else its length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


class Pool:
    """Nodes of all versions of one block's tree; a node never changes once it is added."""

    def __init__(self, leaves: list[bytes], whole: bool):
        self.hashes: list[bytes] = []
        self.children: list[tuple[int, ...]] = []
        self.levels = [[self.add(h, ()) for h in leaves]]
        while len(self.levels[-1]) > 1 or not whole and len(self.levels) <= LEVELS:
            below = self.levels[-1]
            runs = (tuple(below[k : k + ARITY]) for k in range(0, len(below), ARITY))
            self.levels.append([self.parent(run) for run in runs])

    def add(self, value: bytes, children: tuple[int, ...]) -> int:
        self.hashes.append(value)
        self.children.append(children)
        return len(self.hashes) - 1

    def parent(self, children: tuple[int, ...]) -> int:
        return self.add(digest(*[self.hashes[c] for c in children]), children)

    @property
    def root(self) -> bytes:
        return self.hashes[self.levels[-1][0]]

    def siblings(self, place: int) -> bytes:
        """The other node of the run at every level, from the leaf up, each after its side."""
        out = []
        for level in self.levels[:-1]:
            other = place ^ 1
            if other >= len(level):
                out.append(LONE)
            else:
                out += [LEFT if other < place else RIGHT, bytes.fromhex(self.hashes[level[other]].decode())]
            place >>= 1
        return b"".join(out)

    def version(self, place: int, value: bytes) -> list[int]:
        """A version in which one leaf differs: the new leaf and its copied ancestors, the last one its root."""
        new = [self.add(value, ())]
        for level in self.levels[1:]:
            old = self.levels[len(new) - 1][place]
            place >>= 1
            kept = self.children[level[place]]
            new.append(self.parent(tuple(new[-1] if c == old else c for c in kept)))
        return new


def steps(siblings: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling as text) level by level."""
    at = 0
    while at < len(siblings):
        side = siblings[at : at + 1]
        size = 0 if side == LONE else 32
        yield side, siblings[at + 1 : at + 1 + size].hex().encode()
        at += 1 + size


def climb(value: bytes, siblings: bytes) -> list[bytes]:
    """Ancestors of a node, recomputed from it and its siblings, the topmost one last."""
    out = []
    for side, other in steps(siblings):
        value = digest(other, value) if side == LEFT else digest(value, other) if side == RIGHT else digest(value)
        out.append(value)
    return out


def _block_of(table: pa.Table) -> pa.Table:
    """Siblings of every node of a block, the block's root, and what the versions of its changed nodes add."""
    table = table.sort_by("place")
    pool = Pool([h.encode() for h in table["hash"].to_pylist()], table["alone"][0].as_py())
    changed = table["changed"].to_pylist()
    copied = [None if c is None else [pool.hashes[k].decode() for k in pool.version(j, c.encode())] for j, c in enumerate(changed)]
    return table.select(["key", "place", "hash", "payload"]).append_column(
        "siblings", pa.array([pool.siblings(j) for j in range(len(table))], pa.binary())
    ).append_column("copied", pa.array(copied, pa.list_(pa.string()))).append_column(
        "block_root", pa.array([pool.root.decode()] * len(table), pa.string())
    )


def trees(nodes: DataFrame) -> DataFrame:
    """(key, place, hash, payload, siblings, copied, block_root, upper, root) of ``nodes`` (key, place, hash, changed, payload).

    ``siblings`` lead to ``block_root`` and ``upper`` from there to ``root``, the root of the key's tree.
    """
    spark = nodes.sparkSession
    sizes = nodes.groupBy(F.col("key").alias("its_key")).agg(F.count(F.lit(1)).alias("size"))
    sized = nodes.join(sizes, F.col("key").eqNullSafe(F.col("its_key")))
    block = F.expr(f"place div {BLOCK}")
    kind = nodes.schema
    out = T.StructType([kind["key"], kind["place"], kind["hash"], kind["payload"], T.StructField("siblings", T.BinaryType()),
                        T.StructField("copied", T.ArrayType(T.StringType())), T.StructField("block_root", T.StringType())])
    dealt = sized.withColumn("alone", F.col("size") <= BLOCK).drop("its_key", "size")
    built = cut(dealt.groupBy("key", block.alias("block")).applyInArrow(_block_of, out))
    tops = cut(built.filter(F.col("place") % BLOCK == 0).select(
        "key", block.alias("place"), F.col("block_root").alias("hash"), F.lit(None).cast("string").alias("changed"),
        F.lit(None).cast(kind["payload"].dataType).alias("payload"),
    ))
    if tops.filter("place > 0").isEmpty():
        return built.withColumns({"upper": F.lit(b""), "root": F.col("block_root")})
    above = trees(tops).select(
        F.col("key").alias("its_key"), F.col("place").alias("its_block"), F.concat("siblings", "upper").alias("upper"), "root"
    )
    return built.join(above, F.col("key").eqNullSafe(F.col("its_key")) & (block == F.col("its_block"))).drop("its_key", "its_block")


FINISHED = T.StructType([T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()),
                         T.StructField("copied", T.ArrayType(T.StringType()))])


@F.arrow_udf(FINISHED)
def finished(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Digest of all siblings and the root that a leaf leads to: its version's, where it has one."""
    for leaves, copied, inner, upper in batches:
        rows = []
        for value, version, low, high in zip(*(x.to_pylist() for x in (leaves, copied, inner, upper))):
            proof = sha256(b"".join(other for _, other in steps(low + high))).hexdigest()
            new = None
            if version is None:
                up = climb(value.encode(), low + high)
                folded = (up or [value.encode()])[-1].decode()
            else:
                new = version + [h.decode() for h in climb(version[-1].encode(), high)]
                folded = new[-1]
            rows.append((proof, folded, new))
        proofs, roots, new = zip(*rows) if rows else ((), (), ())
        yield pa.StructArray.from_arrays(
            [pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array(new, pa.list_(pa.string()))], FINISHED.names
        )


def manifest(rows: DataFrame, doc_id: str = "doc_id", group: str = "lang") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, copied, siblings) of ``rows`` (id, group, leaf, changed).

    ``changed`` is the leaf of a row as it is found later, NULL where nothing changed. ``siblings`` is the audit
    path from the leaf to the root; ``copied`` are the nodes that the version of a changed leaf adds, from the leaf to its root.
    """
    named = only(rows, group, doc_id, "leaf", "changed")
    placed = places(named, [group], [doc_id, "leaf"], "place")
    nodes = placed.select(F.col(quoted(group)).alias("key"), "place", F.col("leaf").alias("hash"), "changed",
                          F.col(quoted(doc_id)).alias("payload"))
    grouped = trees(nodes)
    # one row per group, above which the same tree goes on
    subroots = places(cut(grouped.filter("place = 0").select("key", F.col("root").alias("hash"))), [], ["key"], "place")
    top = trees(cut(subroots.select(F.lit(0).alias("key"), "place", "hash", F.lit(None).cast("string").alias("changed"),
                                    F.struct(F.col("key").alias("group")).alias("payload"))))
    top = cut(top.select(F.col("payload.group").alias("its_group"), F.concat("siblings", "upper").alias("beyond"), F.col("root").alias("whole_root")))
    joined = grouped.join(top, F.col("key").eqNullSafe(F.col("its_group")))
    high = F.concat("upper", "beyond")
    done = joined.withColumn("done", finished("hash", "copied", "siblings", high))
    return done.select(
        F.col("payload").alias(doc_id), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("whole_root").alias("root"),
        "done.proof_sha256", "done.folded_root", "done.copied", F.concat("siblings", high).alias("siblings"),
    )
