"""Language identification against a plain naive Bayes, held-out accuracy, and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkbars.llm import langid
from sparkbars.llm.queries import op10_language_id
from tests.llm.helpers import documents

TEXTS = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "the end of the day", "la fin du jour", "das ende vom tag",
         None, "", "123 !?", "The CAT", "le jour", "die katze", "the cat and the dog"]
LANGS = ["en", "fr", "de", "en", "fr", "de", "en", "fr", "de", None, None, None, "en"]
SCHEMA = "doc_id long, text string, lang string"


def buckets(text):
    letters = langid.letter_table()
    out = []
    for rows, starts, codes in langid.blocks([text]):
        for bucket in langid.hashed(codes, starts, letters):
            out += [b for b in bucket.tolist() if b]
    return out


def plain(texts, langs, smoothing=0.1):
    docs, counts = Counter(x for x in langs if x), defaultdict(Counter)
    for t, x in zip(texts, langs):
        if x:
            counts[x].update(buckets(t))
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append("und")
            continue
        scores = {}
        for x in sorted(docs):
            total = sum(counts[x].values()) + smoothing * (langid.BUCKETS - 1)
            scores[x] = math.log(docs[x] / sum(docs.values())) + sum(math.log((counts[x][b] + smoothing) / total) for b in buckets(t)) / len(langid.ORDERS)
        out.append(max(scores, key=lambda x: scores[x]))
    return out


@pytest.mark.parametrize("width", [64, 2])
def test_matches_a_plain_classifier(spark, monkeypatch, width):
    monkeypatch.setattr(langid, "LANGUAGES_PER_BLOCK", width)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(TEXTS, LANGS))], SCHEMA)
    model = langid.train(docs)
    rows = sorted(langid.predict(docs, model).select("doc_id", "language.*").collect())
    assert [r["lang_pred"] for r in rows] == plain(TEXTS, LANGS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len(model.weights) == (1 if width == 64 else 2)


def test_pieces_of_a_text_have_the_ngrams_of_the_whole():
    text = "Ünïcode wörds and 中文 " * 30
    letters = langid.letter_table()
    want = Counter(b for _, s, c in langid.blocks([text]) for x in langid.hashed(c, s, letters) for b in x.tolist() if b)
    for size in (1, 2, 7, 50):
        got = Counter(b for _, s, c in langid.blocks([text, None, ""], size) for x in langid.hashed(c, s, letters) for b in x.tolist() if b)
        assert got == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op10_language_id(spark, sf).filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_query_covers_every_row_of_an_odd_table(spark, tmp_path):
    path = documents(tmp_path, TEXTS + ["x" * 2_000_000], dict(enumerate(LANGS)))
    rows = {r["doc_id"]: r for r in op10_language_id(spark, path).collect()}
    assert len(rows) == len(TEXTS) + 1
    assert [rows[i]["lang_pred"] for i in (6, 7, 8)] == ["und"] * 3


def test_nothing_labelled_and_nothing_at_all(spark):
    docs = spark.createDataFrame([(1, "hello", None)], SCHEMA)
    assert [tuple(r["language"]) for r in langid.predict(docs, langid.train(docs)).collect()] == [("und", 0.0)]
    empty = docs.filter("false")
    assert langid.keep(empty, langid.train(empty), 0.5).collect() == []


def test_keep_leaves_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 7), (2, "77", "en", 8)], SCHEMA + ", verdict int")
    kept = langid.keep(docs, langid.train(docs), 0.5)
    assert [tuple(r) for r in kept.collect()] == [(1, "the cat", "en", 7)] and kept.columns == docs.columns
