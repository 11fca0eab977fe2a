"""Token ids in training order: a keyed permutation of sequences, written as fixed-stride binary shards.

The ids of all texts, each followed by the end token, form one stream in the order of the
input files; the stream is cut into sequences of ``length`` ids, the last one filled up with
end tokens. A Feistel network with keyed rounds permutes the sequence numbers; numbers that
fall outside are walked through it again until they fall inside (cycle-walking), so every
sequence has a slot of its own from 0 to n - 1 without any table or sort. Shard k holds the
slots from k * per_shard on, one after the other at a fixed stride: slot s lies at byte
``(s % per_shard) * stride`` of file ``s // per_shard``, so a reader can go on from any slot.

Encoded texts are written once; stream positions are running sums inside each of its
partitions plus one offset per partition. One shuffle by shard brings the pieces of the
sequences together, and every task streams a run of neighbouring shards, each to a file of its own, renamed when it is whole, so a
repeated attempt does no harm. A shard that is already there is left as it is if its content, read again, has the same digest;
another content, of other texts or another key, is replaced, and shards beyond the last one go.

Defined results: a NULL text counts as an empty one and is one end token; repeated rows are
repeated in the stream; very long texts are encoded whole; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.llm.bpe import read_ranks
from sparkbars.llm.columns import only
from sparkbars.session import cut, scratch_root

ROUNDS = 6
MAX_TASKS = 16_384  # that write shards
CHARS_AT_ONCE = 1 << 22
ZSTD_LEVEL = 9
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": ZSTD_LEVEL, "parquet.page.size": 8 << 20}


@dataclass(frozen=True)
class Layout:
    """``dtype`` must hold every id and the end token."""

    length: int = 1024
    per_shard: int = 8192
    dtype: str = "<u2"
    end_token: int = 50256
    key: int = 0x5EED

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix of numbers: multiplications by odd constants and shifts."""
    x = half + np.uint64(key)
    for multiplier, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of every sequence number: a permutation of 0 to n - 1."""
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = np.asarray(numbers).astype(np.uint64)
    outside = np.arange(len(out))
    while len(outside):
        left, right = out[outside] >> np.uint64(half), out[outside] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[outside] = (left << np.uint64(half)) | right
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, path: str, pattern: str, layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (doc_id, part, at, n, ids): ids of every row and its place inside its partition."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))
    own = only(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, split = shared.value
        library = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        part, at = TaskContext.get().partitionId(), 0

        def batch_of(names, ids: list) -> pa.RecordBatch:
            nonlocal at
            n = np.array([len(x) for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [names, pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(n)]
            packed = pa.array([x.tobytes() for x in ids], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, packed], ["doc_id", "part", "at", "n", "ids"])

        for batch in batches:
            first, ids, chars = 0, [], 0
            for row, text in enumerate(batch.column(1)):
                content = text.as_py() or ""
                ids.append(np.array([*library.encode_ordinary(content), layout.end_token], layout.dtype))
                chars += len(content)
                if chars >= CHARS_AT_ONCE:
                    yield batch_of(batch.column(0)[first : row + 1], ids)
                    first, ids, chars = row + 1, [], 0
            if ids:
                yield batch_of(batch.column(0)[first:], ids)

    table = own.mapInArrow(encode, f"doc_id {kind}, part int, at long, n long, ids binary")
    folder = f"{scratch_root(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    table.write.options(**ZSTD).parquet(folder)
    return docs.sparkSession.read.schema(table.schema).parquet(folder)


def placed(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``tokens`` with ``start``, its place in the whole stream, and the length of the stream."""
    parts = tokens.groupBy("part").agg(F.sum("n").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per written partition
    offsets = cut(parts.select(F.col("part").alias("own"), "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    total = offsets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    joined = tokens.join(offsets, tokens["part"] == offsets["own"])
    return joined.withColumn("start", F.col("at") + F.col("offset")).drop("own", "size", "offset"), int(total)


def _pieces(layout: Layout, n: int):
    """Cuts the ids of texts at sequence borders: (shard, slot, at, ids), the ids compressed for the shuffle."""
    width = np.dtype(layout.dtype).itemsize

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(ZSTD_LEVEL)
        for batch in batches:
            size, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first, last = start // layout.length, (start + size - 1) // layout.length
            count = last - first + 1
            row = np.repeat(np.arange(len(size)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(number * layout.length, start[row])
            stop = np.minimum((number + 1) * layout.length, (start + size)[row])
            # the pieces of a text follow one another, so the bytes stay as they are and only the cuts are new
            content = pa.concat_arrays([batch.column(2)])
            data = b"".join(x.as_buffer().to_pybytes() for x in content)
            offsets = np.r_[0, np.cumsum((stop - begin) * width)]
            packed = [press.compress(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            slot = slots(number, n, layout.key)
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot // layout.per_shard).astype(np.int32)), pa.array(slot), pa.array((begin % layout.length).astype(np.int32)),
                 pa.array(packed, pa.binary())],
                ["shard", "slot", "at", "ids"],
            )

    return cut_up


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _writer(folder: str, layout: Layout, n: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        unpress = zstandard.ZstdDecompressor()
        sink, shard, digest, size, name = None, -1, None, 0, ""
        done = []

        def held(path: str, want: int) -> str | None:
            """Digest of a file of the wanted size, which an earlier run or attempt may have left."""
            there = system.get_file_info(path)
            if there.type != fs.FileType.File or there.size != want:
                return None
            found = hashlib.sha256()
            with system.open_input_stream(path) as file:
                while data := file.read(1 << 20):
                    found.update(data)
            return found.hexdigest()

        def close() -> None:
            nonlocal sink
            want = min(n - shard * layout.per_shard, layout.per_shard) * layout.stride
            if size != want:
                raise ValueError(f"{shard_name(shard)} has {size} of {want} bytes")
            sink.close()
            final = f"{root}/{shard_name(shard)}"
            if held(final, want) == digest.hexdigest():
                system.delete_file(name)
            else:
                if system.get_file_info(final).type == fs.FileType.File:
                    system.delete_file(final)
                system.move(name, final)
            done.append((shard, want // layout.stride, want, digest.hexdigest()))
            sink = None

        def put(data: bytes) -> None:
            nonlocal size
            sink.write(data)
            digest.update(data)
            size += len(data)

        for batch in batches:
            for own, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                if own != shard or sink is None:
                    if sink is not None:
                        close()
                    shard, digest, size = own, hashlib.sha256(), 0
                    name = f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(name)
                put(unpress.decompress(ids))
        if sink is not None:
            close()
        columns = list(zip(*done)) if done else [(), (), (), ()]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "sequences", "bytes", "sha256"])

    return write


def materialise(tokens: DataFrame, folder: str, layout: Layout = Layout()) -> tuple[DataFrame, DataFrame]:
    """Writes the shards of a table from ``encoded`` to ``folder``.

    Returns the manifest (shard, sequences, bytes, sha256) and the index (doc_id, n_tokens,
    start, first_slot, shard, byte_offset) that tells where each text begins.
    """
    spark = tokens.sparkSession
    stream, total = placed(tokens)
    n = -(-total // layout.length)
    shards = max(-(-n // layout.per_shard), 1)
    rows = stream.select("n", "start", "ids")
    if missing := n * layout.length - total:
        filler = np.full(missing, layout.end_token, layout.dtype).tobytes()
        last = spark.range(1).select(F.lit(missing).cast("long").alias("n"), F.lit(total).cast("long").alias("start"), F.lit(filler).alias("ids"))
        rows = rows.unionByName(last)
    pieces = rows.mapInArrow(_pieces(layout, n), "shard int, slot long, at int, ids binary")
    _folder(folder, shards)
    run = -(-shards // MAX_TASKS)  # neighbouring shards of one task
    dealt = pieces.repartitionById(-(-shards // run), F.expr(f"CAST(shard div {run} AS INT)")).sortWithinPartitions("shard", "slot", "at")
    manifest = cut(dealt.mapInArrow(_writer(folder, layout, n), "shard int, sequences long, bytes long, sha256 string"))
    return manifest, index(stream, n, layout)


def _folder(folder: str, shards: int) -> None:
    """Makes the folder and clears it of shards beyond the last one, which an earlier, larger run left."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    for there in system.get_file_info(fs.FileSelector(root)):
        if (name := there.base_name).startswith("shard-") and name.endswith(".bin") and int(name[6:-4]) >= shards:
            system.delete_file(there.path)


def index(stream: DataFrame, n: int, layout: Layout) -> DataFrame:
    """Where each text begins: its first sequence's slot, and the byte in that slot's shard."""
    width = np.dtype(layout.dtype).itemsize
    kind = stream.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column(2).to_numpy()
            slot = slots(start // layout.length, n, layout.key)
            byte = slot % layout.per_shard * layout.stride + start % layout.length * width
            columns = [*batch.columns, pa.array(slot), pa.array((slot // layout.per_shard).astype(np.int32)), pa.array(byte)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "start", "first_slot", "shard", "byte_offset"])

    return stream.select("doc_id", F.col("n").alias("n_tokens"), "start").mapInArrow(
        find, f"doc_id {kind}, n_tokens long, start long, first_slot long, shard int, byte_offset long"
    )


def read_slots(folder: str, first: int, count: int, layout: Layout = Layout()) -> Iterator[np.ndarray]:
    """Sequences in training order from any slot on, reading each shard sequentially."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    while count > 0:
        shard, inside = divmod(first, layout.per_shard)
        with system.open_input_file(f"{root}/{shard_name(shard)}") as file:
            file.seek(inside * layout.stride)
            while count > 0 and inside < layout.per_shard:
                data = file.read(layout.stride)
                if not data:
                    return
                yield np.frombuffer(data, layout.dtype)
                inside, first, count = inside + 1, first + 1, count - 1
