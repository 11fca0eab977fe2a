"""Sharding by extendible hashing: a bucket splits on one more hash bit only while it is too large.

The directory starts with one bucket of depth 0. Byte sums of hash prefixes, not documents,
decide which buckets split: one round adds up ``STEP_BITS`` levels at once, and only
prefixes that are still too large at its end go into another round. A bucket is closed at
the first depth at which it fits. Rows find their bucket by their prefix.

The hash covers id and text, so copies under other ids part, and so do rows of one id with
different texts. Rows that are equal in both have one hash, and no further bit parts them:
such a bucket, as deep as the hash and still too large, is dealt into slices that fit by a
running number. Only a single row that is larger than the limit stays over it, alone, and is marked.

Defined results: a NULL id or text hashes like a value of its own, a NULL text has 0 bytes;
an empty table has no shards; which of several equal rows goes to which slice is arbitrary; a text longer than the
limit is a shard or slice of its own, whole, and marked as over the limit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.llm.columns import only
from sparkbars.operators.running import row_index
from sparkbars.session import cut

HASH_BITS = 60  # 15 hexadecimal digits of an md5 sum
STEP_BITS = 20
LIMIT_BYTES = 128 << 20
ROWS_PER_CHUNK_BITS = 16


def hash_key(*columns: Column) -> Column:
    """60 hash bits of some columns as a long."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(value: Column, drop: Column) -> Column:
    return F.call_function("shiftright", value, drop.cast("int"))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(depth, bucket, shard_bytes, shard_rows): the closed buckets for a written table (key, bytes)."""
    closed, rest, top = [], sized, 0
    while True:
        last = min(top + STEP_BITS, HASH_BITS)
        deepest = rest.groupBy(_prefix(F.col("key"), F.lit(HASH_BITS - last)).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
        )
        levels = deepest.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(last))))
        levels = levels.withColumn("bucket", _prefix(F.col("bucket"), F.lit(last) - F.col("depth")))
        levels = cut(levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)
        split = levels.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
        children = levels.filter(fits & (F.col("depth") > top)).withColumn("parent", F.shiftright("bucket", 1))
        closed.append(children.join(split, ["depth", "parent"], "left_semi").drop("parent"))
        closed.append(levels.filter(fits & (F.col("depth") == top)))
        large = cut(levels.filter(~fits & (F.col("depth") == last)).select(F.col("bucket").alias("over")))
        if large.isEmpty():
            break
        over = _prefix(F.col("key"), F.lit(HASH_BITS - last))
        rest = cut(rest.withColumn("over", over).join(large, "over", "left_semi").drop("over"))
        top = last
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return cut(out)


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shard of every row of ``docs``: (doc_id, n_bytes, shard, depth, slice, shard_bytes, shard_rows, over_limit).

    ``shard`` is the bit string of the bucket. Texts are read once, for their size and hash.
    """
    own = only(docs, doc_id, text)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    sized = cut(own.select(
        F.col(doc_id).alias("doc_id"), hash_key(F.col(doc_id), F.col(text)).alias("key"), size.alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    ))
    shards = directory(sized, limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most HASH_BITS + 1 numbers
    if not depths:
        depths = [0]
    places = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), F.lit(HASH_BITS - d)).alias("bucket")) for d in depths])
    looked = sized.withColumn("at", F.explode(places)).select("doc_id", "key", "bytes", "row", "at.depth", "at.bucket")
    found = looked.join(shards, ["depth", "bucket"])
    equal = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    bits = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("")
    rows = found.select("doc_id", "key", F.col("bytes").alias("n_bytes"), "row", bits.alias("shard"), "depth", "shard_bytes", "shard_rows")
    whole = rows.filter(~equal).withColumn("slice", F.lit(0).cast("long"))
    return _ordered(whole).unionByName(_ordered(_sliced(rows.filter(equal), limit)), allowMissingColumns=False).withColumn(
        "over_limit", F.col("shard_bytes") > limit
    )


def _sliced(rows: DataFrame, limit: int) -> DataFrame:
    """Deals equal rows into slices of as many as fit; the numbering is split into chunks of rows."""
    fitting = F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))
    chunked = cut(rows.withColumn("chunk", F.shiftright("row", ROWS_PER_CHUNK_BITS)))
    numbered = row_index(chunked, ["key"], "chunk", ["row"], "number").withColumn("fitting", fitting)
    start = F.floor(F.col("number") / F.col("fitting"))
    here = F.least(F.col("fitting"), F.col("shard_rows") - start * F.col("fitting"))
    return numbered.withColumns({
        "slice": start.cast("long"), "shard_rows": here.cast("long"), "shard_bytes": (here * F.col("n_bytes")).cast("long"),
    })


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_bytes", "shard", "depth", "slice", "shard_bytes", "shard_rows")
