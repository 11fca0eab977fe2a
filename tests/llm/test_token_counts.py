"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkbars.llm import token_counts
from sparkbars.llm.queries import op8_token_counts
from tests.llm.helpers import documents
from tests.llm.test_bpe import PARTS

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LIBRARY = Tokenizer.from_file(PATH)
MORE = [*PARTS, "<|end", "|>", "v", "ll", "      "]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as file:
        return token_counts.Counter(file.read(), PATTERN)


@pytest.mark.parametrize("chunk, overlap", [(20, 3), (33, 8), (64, 1), (400, 16)])
def test_spliced_chunks_match_the_library(counter, chunk, overlap):
    rng = random.Random(chunk)
    widened = 0
    for _ in range(400):
        parts = rng.sample(MORE, rng.randint(1, len(MORE)))
        text = "".join(rng.choices(parts, k=rng.randint(0, 90)))
        tokens, chunks, wide = counter.spliced(text, chunk, overlap)
        assert tokens == library(text), text
        assert chunks == max(-(-len(text) // chunk), 1)
        widened += wide
    assert widened > 0 or chunk == 400


def test_huge_texts(counter):
    for text in ("a" * 100_000, " " * 70_000, "ab 1" * 30_000, "x" * 50_000 + " y " * 9_000 + "é" * 30_000):
        tokens, chunks, _ = counter.counts([text])[0]
        assert chunks > 1 and tokens == library(text)


def test_query_covers_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b", "twice", "twice", "word " * 512, "word" + " word" * 511, "é漢 " * 40_000]
    texts += ["".join(rng.choices(MORE, k=50)) for _ in range(50)]
    rows = {r["doc_id"]: r for r in op8_token_counts(spark, documents(tmp_path, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n = library(text or "")
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_other_kinds_of_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.TokenCounter(spark, public_tokenizers.path("word_bpe_49k.json"), PATTERN)


def test_empty_table(spark, tmp_path):
    assert op8_token_counts(spark, documents(tmp_path, [])).collect() == []
