"""Quality rules against word-by-word counting."""

import random
import re

from sparkbars.llm import quality
from sparkbars.llm.queries import op9_quality_rules
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, rules):
    words = WORD.findall(text or "")
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    inside = lambda least, size: len({w for i in range(n) if longest[i] >= least for w in range(i, i + size(i))})
    repeat, cover = inside(3, lambda i: 3), inside(rules.min_words, lambda i: longest[i])
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = n < 50 or 100 * repeat > 50 * n
    top = max(longest, default=0)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup,
        "n_repeat_words": repeat, "covered_words": cover, "longest_repeat": top, "base_failed": base,
        "kept": not base and 100 * cover <= rules.max_percent * n and top <= rules.max_longest,
    }


def test_matches_counting(spark, tmp_path):
    rng = random.Random(2)
    alphabet = ["a", "b", "cé", "d$", "e f", "\U0001f600", "#", "g" * 30]
    texts = [None, "", " \n\t", "one", "x " * 400, "\n".join(["same line here"] * 5)]
    for _ in range(120):
        words = rng.choices(alphabet[: rng.randint(1, 8)] + [f"w{i}" for i in range(rng.choice([0, 5, 300]))], k=rng.choice([3, 20, 60, 120]))
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " middle " + " ".join(f"q{i}" for i in range(200)) + " " + passage, passage, texts[-1], texts[-1]]
    rules = quality.RepetitionRules()
    rows = {r["doc_id"]: r.asDict() for r in op9_quality_rules(spark, documents(tmp_path, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i] == {"doc_id": i} | plain(text, rules), (i, text)
    assert not rows[len(texts) - 4]["kept"] and not rows[len(texts) - 4]["base_failed"] and rows[len(texts) - 3]["kept"]


def test_maximal_repeats_are_reported_with_their_places():
    text = b"a b c d e x a b c d e y b c d e"
    _, spans = quality.measured([text, None], 3)
    found = sorted((int(s), int(n)) for row, start, length in spans for s, n in zip(start, length))
    assert found == [(0, 5), (6, 5), (12, 4)]


def test_blocks_do_not_change_results(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))).encode() for _ in range(60)]
    whole = quality.measured(texts, 4)[0]
    monkeypatch.setattr("sparkbars.llm.quality.word_blocks", lambda words: __import__("sparkbars.llm.suffixes", fromlist=["x"]).word_blocks(words, 10))
    for name, values in quality.measured(texts, 4)[0].items():
        assert (values == whole[name]).all(), name


def test_keep_and_empty_table(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, 1), (2, "short", 2), (3, None, 3), (4, "loop " * 90, 4)], "doc_id long, text string, verdict int")
    assert [tuple(r) for r in quality.keep(docs).collect()] == [(1, good, 1)]
    assert quality.keep(docs.filter("false")).collect() == []


def pasted(percent, n=400, passage=20):
    """``n`` words of which ``percent`` are a pasted passage, scattered among words that occur once."""
    copies = n * percent // 100 // passage
    boilerplate = [f"b{i}" for i in range(passage)]
    own = [f"own{i}" for i in range(n - copies * passage)]
    step = len(own) // max(copies, 1)
    return " ".join(sum((own[k * step : (k + 1) * step] + boilerplate for k in range(copies)), []) + own[copies * step :])


def test_pasted_passages_below_the_base_rule_are_dropped(spark, tmp_path):
    texts = [pasted(p) for p in (0, 10, 15, 20, 25, 30, 35, 40)]
    rows = {r["doc_id"]: r for r in op9_quality_rules(spark, documents(tmp_path, texts)).collect()}
    assert [rows[i]["covered_words"] for i in range(8)] == [0, 40, 60, 80, 100, 120, 140, 160]
    assert not any(rows[i]["base_failed"] for i in range(8))
    assert [rows[i]["kept"] for i in range(8)] == [True] * 3 + [False] * 5
