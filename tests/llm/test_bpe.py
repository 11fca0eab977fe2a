"""Byte-level BPE against tiktoken, a plain merge loop, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkbars.llm import bpe, pretokens
from sparkbars.llm.queries import op2_byte_bpe
from tests.llm.helpers import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "b", "é", "ß", " ", "\n", " ", "1", "²", "!", "'s", "'", "re", "՘", "\U0003fc3d", "漢字", "🙂", "\t", "aaaa", "the", "<|endoftext|>", "   ", "̀"]


def library(text):
    return np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.sample(PARTS, rng.randint(1, len(PARTS))), k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("at_once", [5, 1 << 15])
def test_matches_the_library(monkeypatch, at_once):
    monkeypatch.setattr(bpe, "MERGED_AT_ONCE", at_once)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 40)
    own = bpe.encoder(RANKS, PATTERN)
    texts = some_texts(1, 800) + ["a" * 30_000, "xyzzy" * 9_000, "é" * 5_000, " " * 2_000]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == library(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 3)
    own = bpe.encoder(RANKS, PATTERN)
    texts = some_texts(2, 100)
    assert list(own.encode(texts)) == [library(t) for t in texts]


def test_ranks_in_any_order_match_plain_merging():
    """Files whose later ranks open lower ones: the lowest rank always goes first."""
    rng = random.Random(3)
    for _ in range(60):
        tokens = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(tokens)
        ranks = {bytes([b]): 1000 + b for b in range(256)} | {t: i for i, t in enumerate(tokens)}
        own = bpe.Encoder(ranks, None)
        pieces = [bytes(rng.choices(b"abcd", k=rng.randint(1, 30))) for _ in range(20)]
        ids, first = own.merge(pieces)
        for i, piece in enumerate(pieces):
            parts = [piece[k : k + 1] for k in range(len(piece))]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: (ranks.get(parts[k] + parts[k + 1], 1 << 30), k))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            assert ids[first[i] : first[i + 1]].tolist() == [ranks[p] for p in parts]


def test_every_character_is_classed_as_by_the_library():
    ask = bpe.tiktoken_class(RANKS)
    split = pretokens.Splitter(PATTERN, ask)
    letter = tiktoken.Encoding("l", pat_str=r"\p{L}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    chars = [chr(c) for c in [*range(0x100, 0x3000, 7), *range(0x10000, 0x30000, 911), 0x558, 0x3FC3D]]
    for c in chars:
        alone = split.split("a" + c) == ["a" + c]
        assert alone == bool(letter.encode_ordinary(c)), hex(ord(c))


def test_query_covers_odd_rows(spark, tmp_path):
    texts = [None, "", " ", *some_texts(4, 60), "same text", "same text", "long word" + "x" * 300_000]
    rows = {r["doc_id"]: r for r in op2_byte_bpe(spark, documents(tmp_path, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library(text or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_round_trip_and_empty_table(spark):
    tokens = bpe.Tokenizer(spark, PATH, PATTERN)
    docs = spark.createDataFrame([("é 漢 🙂", 1), (None, 2)], "text string, ids int")
    back = docs.select(tokens.decode(tokens.encode(F.col("text"))).cast("string").alias("b"))
    assert [r["b"] for r in back.collect()] == ["é 漢 🙂", ""]
    assert docs.filter("false").select(tokens.digest(F.col("text"))).collect() == []


def test_files_without_all_bytes_are_refused(tmp_path):
    (tmp_path / "x.tiktoken").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "x.tiktoken"))
