"""Token files: the permutation, a round trip through the shards, and resuming."""

import glob
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkbars.llm import token_files
from sparkbars.llm.bpe import read_ranks
from sparkbars.llm.queries import op6_token_files
from tests.llm.helpers import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
TEXTS = [None, "", "one", "one", "some words " * 40, "é漢🙂", *[f"text number {i} " * (i % 9) for i in range(120)]]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 70_001])
def test_slots_are_a_permutation(n):
    for key in (0, 1, 99):
        got = token_files.slots(np.arange(n), n, key)
        assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or (token_files.slots(np.arange(n), n, 1) != token_files.slots(np.arange(n), n, 2)).any()


def written(spark, tmp_path, layout, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string")
    tokens = token_files.encoded(docs.repartition(5), PATH, PATTERN, layout)
    folder = f"file://{tmp_path}/out"
    manifest, index = token_files.materialise(tokens, folder, layout)
    return folder, {r["shard"]: r for r in manifest.collect()}, index.collect(), tokens


@pytest.mark.parametrize("length, per_shard", [(8, 5), (64, 1000), (1, 300)])
def test_every_text_comes_back(spark, tmp_path, length, per_shard):
    layout = token_files.Layout(length=length, per_shard=per_shard)
    rows = [(i if i else None, t, 0, "x") for i, t in enumerate(TEXTS)]
    folder, manifest, index, _ = written(spark, tmp_path, layout, rows)
    total = sum(len(LIBRARY.encode_ordinary(t or "")) + 1 for t in TEXTS)
    n = -(-total // length)
    sequences = list(token_files.read_slots(folder, 0, n, layout))
    assert len(sequences) == n and all(len(s) == length for s in sequences)
    assert sum(r["sequences"] for r in manifest.values()) == n and len(manifest) == -(-n // per_shard)
    assert all(os.path.getsize(f"{tmp_path}/out/{token_files.shard_name(s)}") == r["bytes"] for s, r in manifest.items())
    stream = np.concatenate([sequences[s] for s in token_files.slots(np.arange(n), n, layout.key)])
    assert (stream[total:] == layout.end_token).all()
    for row in index:
        part = stream[row["start"] : row["start"] + row["n_tokens"]]
        assert part.tolist() == [*LIBRARY.encode_ordinary(TEXTS[row["doc_id"] or 0] or ""), layout.end_token]
        with open(f"{tmp_path}/out/{token_files.shard_name(row['shard'])}", "rb") as file:
            file.seek(row["byte_offset"])
            assert np.frombuffer(file.read(2), "<u2")[0] == part[0]
    middle = list(token_files.read_slots(folder, n // 2, 3, layout))
    assert all((a == b).all() for a, b in zip(middle, sequences[n // 2 :]))


def test_shards_that_are_there_stay(spark, tmp_path):
    layout = token_files.Layout(length=8, per_shard=5)
    folder, manifest, _, tokens = written(spark, tmp_path, layout, [(i, t, 0, "x") for i, t in enumerate(TEXTS)])
    files = sorted(glob.glob(f"{tmp_path}/out/*"))
    before = {f: os.stat(f).st_ino for f in files}
    with open(files[2], "wb") as file:
        file.write(b"cut off")
    again, _ = token_files.materialise(tokens, folder, layout)
    assert {r["shard"]: r for r in again.collect()} == manifest
    assert os.path.getsize(files[2]) == manifest[2]["bytes"]
    assert sorted(glob.glob(f"{tmp_path}/out/*")) == files and not glob.glob(f"{tmp_path}/out/.*")
    assert all(os.stat(f).st_ino == i for f, i in before.items() if f != files[2])


def test_other_content_in_the_same_folder_is_replaced(spark, tmp_path):
    rows = [(i, t, 0, "x") for i, t in enumerate(TEXTS)]
    first = token_files.Layout(length=8, per_shard=5, key=1)
    other = token_files.Layout(length=8, per_shard=5, key=2)
    _, old, _, _ = written(spark, tmp_path, first, rows)
    _, new, _, _ = written(spark, tmp_path, other, [(i, (t or "")[::-1], p, x) for i, t, p, x in rows[: len(rows) // 2]])
    assert {r["bytes"] for r in old.values()} & {r["bytes"] for r in new.values()} and len(new) < len(old)
    files = sorted(glob.glob(f"{tmp_path}/out/*"))
    assert [os.path.basename(f) for f in files] == [token_files.shard_name(s) for s in sorted(new)]
    assert [hashlib.sha256(open(f, "rb").read()).hexdigest() for f in files] == [new[s]["sha256"] for s in sorted(new)]


def test_a_task_may_write_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "MAX_TASKS", 3)
    layout = token_files.Layout(length=8, per_shard=5)
    folder, manifest, _, _ = written(spark, tmp_path, layout, [(i, t, 0, "x") for i, t in enumerate(TEXTS)])
    for shard, row in manifest.items():
        with open(f"{tmp_path}/out/{token_files.shard_name(shard)}", "rb") as file:
            assert hashlib.sha256(file.read()).hexdigest() == row["sha256"]
    assert len(manifest) > 9


def test_query_and_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "a")
    os.makedirs(tmp_path / "b")
    rows = op6_token_files(spark, documents(tmp_path / "a", TEXTS)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    assert op6_token_files(spark, documents(tmp_path / "b", [])).collect() == []
