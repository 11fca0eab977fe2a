"""The corpus pipeline, stage by stage and whole, against plain versions."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from sparkbars.llm.bpe import read_ranks
from sparkbars.llm.quality import RepetitionRules
from sparkbars.session import cut
from tests.llm.helpers import BENCHMARK, DOCUMENTS, documents, folder
from tests.llm.test_nearcopies import plain_kept
from tests.llm.test_quality import plain as plain_quality

LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def corpus(rng):
    vocabulary = [f"word{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(30)) for i in range(4)]
    texts = [None, "", "123 456", "too short", "again and " * 60]
    for i in range(40):
        texts.append(say(rng.randint(60, 120)))
        if i % 4 == 0:
            texts += [texts[-1], texts[-1].upper(), texts[-1] + " more"]
        if i % 5 == 0:
            words = items[i % 4][1].split()
            texts.append(say(50) + " " + " ".join(words[3:14]) + " " + say(50))
    return texts, items


def plain_pipeline(texts, items):
    rows = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t) and plain_quality(t, RepetitionRules())["kept"]]
    kept = plain_kept([t for _, t in rows])
    rows = [rows[k] for k in kept]
    windows = {tuple(w[k : k + 10]) for w in (x.split() for _, x in items) for k in range(len(w) - 9)}
    clean = lambda t: not any(tuple(w[k : k + 10]) in windows for w in [t.lower().split()] for k in range(len(w)))
    return [(i, LIBRARY.encode_ordinary(t)) for i, t in rows if clean(t)]


def test_run_matches_plain_versions(spark, tmp_path):
    texts, items = corpus(random.Random(6))
    path = documents(tmp_path, texts, benchmark=(BENCHMARK, items))
    got = sorted((r["doc_id"], memoryview(r["ids"]).cast("I").tolist()) for r in corpus_pipeline.run(spark, path).collect())
    want = plain_pipeline(texts, items)
    assert got == want and 20 < len(want) < len(texts)


def test_stages_keep_the_columns_they_are_given(spark, tmp_path):
    texts, items = corpus(random.Random(7))
    path = documents(tmp_path, texts, benchmark=(BENCHMARK, items))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ["verdict", "fingerprint", "contamination", "first", "missing", "lang_pred", "n_words"]
    docs = docs.withColumns({n: docs["doc_id"] for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, docs, path))
        assert kept.columns == docs.columns and kept.schema == docs.schema
        assert kept.filter(" or ".join(f"{n} <> doc_id" for n in names)).isEmpty()
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert out.filter("not round_trip").isEmpty() and out.count() == docs.count()


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    texts, items = corpus(random.Random(8))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows = [r[:2] + ("en",) + r[3:] for r in rows] + rows[:9] + [(None, t, "en", "s", 1) for t in texts[-3:]] + [(3, None, None, None, None)]
    path = folder(tmp_path, documents=(DOCUMENTS, rows), benchmark=(BENCHMARK, items))
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()]
    assert None not in got and len(got) == len(set(got)) and len(got) > 20
    folder(tmp_path, documents=(DOCUMENTS, []))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "byte_bpe"]
