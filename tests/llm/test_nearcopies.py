"""Near copies of the pipeline against all pairs of five-word shingle sets."""

import random

import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from sparkbars.llm import nearcopies
from tests.llm.helpers import documents


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b == set() or a | b and len(a & b) >= 0.8 * len(a | b):
                i0, j0 = sorted((find(i), find(j)))
                root[j0] = i0
    return [i for i in range(len(texts)) if find(i) == i]


def changed(rng, text, n):
    """``n`` words far apart replaced, so that each costs five shingles."""
    words = text.split()
    for k in range(n):
        words[8 + 10 * k] = f"new{rng.random()}"
    return " ".join(words)


def test_near_dedup_finds_copies_of_similarity_over_the_limit(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "ONE two", "three words here"]
    for i in range(24):
        base = " ".join(rng.choices(vocabulary, k=200))
        # 196 shingles: n changes leave (196 - 5n) / (196 + 5n), so 4 changes are 0.81 and 5 are 0.77
        texts += [base, changed(rng, base, 4 if i % 2 else 5), base.upper() if i % 3 else base + " tail of words"]
    docs = spark.read.parquet(documents(tmp_path, texts) + "/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got == plain_kept(texts) and len(got) == 24 + 12 + 3


def test_chains_repeated_rows_and_missing_ids(spark):
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(150))
    chain = [base]
    for _ in range(6):
        words = chain[-1].split()
        words[rng.randrange(10, 140)] = f"x{rng.random()}"
        chain.append(" ".join(words))
    rows = [(None, base), *[(10 + i, t) for i, t in enumerate(chain)], (10, base), (3, chain[-1]), (None, "alone " * 3), (None, None), (5, "")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, chain[-1]), (None, "alone " * 3), (5, "")], key=str)
    empty = nearcopies.keep_one(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []


def test_minima_do_not_depend_on_blocks(monkeypatch):
    hashes = nearcopies.shingles([f"w{i}".encode() for i in range(300)])
    whole = nearcopies.minima(hashes)
    monkeypatch.setattr(nearcopies, "SHINGLES_AT_ONCE", 7)
    assert nearcopies.minima(hashes) == whole and len(whole) == 2 * 20 * 7


def family(rng, size, keep):
    """Texts that share a template of 400 words and replace a few of them each: pairs lie on both sides of the limit."""
    template = [f"t{rng.random()}" for _ in range(400)]
    texts = []
    for _ in range(size):
        words = list(template)
        for k in rng.sample(range(0, 400, 10), rng.choice(keep)):
            words[k] = f"own{rng.random()}"
        texts.append(" ".join(words))
    return texts


def partition(spark, texts):
    """The groups that the operator finds, as sets of texts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    drawn = nearcopies.cut(nearcopies.sketched(docs).withColumn("row", nearcopies.F.col("own.doc_id")))
    found = {r["its_row"]: r["root"] for r in nearcopies.groups(drawn, docs).collect()}
    return [found.get(i, i) for i in range(len(texts))]


def plain_roots(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a & b) >= 0.8 * len(a | b):
                links += 1
                i0, j0 = sorted((find(i), find(j)))
                root[j0] = i0
    return [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("few, slice_rows", [(16, 1024), (2, 8)])
def test_template_families_lose_no_link(spark, monkeypatch, few, slice_rows):
    """Families with pairs around 0.8, in buckets that are small, large, and cut into slices."""
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "SLICE", slice_rows)
    rng = random.Random(13)
    texts = family(rng, 60, [2, 4, 5, 8]) + family(rng, 40, [5]) + family(rng, 12, [1]) + family(rng, 30, [9])
    want, links = plain_roots(texts)
    got = partition(spark, texts)
    assert got == want and links > 400 and len(set(want)) > 30


def plain_fingerprint(text):
    hashes = [xxh64_intdigest(" ".join(s), 42) for s in plain_set(text)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_the_trie_join_make_groups(spark, monkeypatch):
    """Without any bucket of minima, texts whose fingerprints the trie join links are still near copies, if their texts are."""
    real = nearcopies._buckets

    def none(distinct):
        return tuple(nearcopies.cut(df.filter("false")) for df in real(distinct))

    monkeypatch.setattr(nearcopies, "_buckets", none)
    monkeypatch.setattr(nearcopies, "SLICE", 4)
    rng = random.Random(15)
    texts, want = [], []
    for i in range(40):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
        other = changed(rng, base, 1 + i % 12)
        a, b = (plain_set(t) for t in (base, other))
        bits = (plain_fingerprint(base) ^ plain_fingerprint(other)).bit_count()
        linked = bits <= 4 and len(a & b) >= 0.8 * len(a | b)
        texts += [base, other]
        want += [2 * i, 2 * i if linked else 2 * i + 1]
    # equal sets of shingles, so equal fingerprints, in texts that differ: one text stands beside many
    again = [" ".join([f"r{k}" for k in range(30)] * n) for n in range(2, 20)]
    want += [len(texts)] * len(again)
    assert partition(spark, texts + again) == want and 8 < len(set(want[:80])) - 40 < 36


def test_very_long_text_clashing_columns_and_a_large_group(spark):
    rng = random.Random(14)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " one more"), (3, long[: len(long) // 2])]
    rows += [(10 + i, f"start of a shared notice that stands in many documents {'and goes on ' * 12} number {i}") for i in range(300)]
    names = ["row", "own", "print", "mins", "body", "its_id", "group", "key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: nearcopies.F.col("doc_id") for n in names})
    kept = nearcopies.keep_one(docs)
    want = plain_kept([t for _, t in rows[3:]])
    got = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and got == [1, 3] + [rows[3 + k][0] for k in want]
