"""Quotation linking against its SQL twin and by hand."""

import random
import struct

import xxhash

from sparkbars.llm.queries import ORACLES, op7_quotation_links
from sparkbars.llm.quotes import parsed, reply_ordered
from tests.llm.helpers import CONVERSATIONS, folder, result, twin

NAME = "op7_quotation_links"


def test_nested_quotes_find_their_messages(spark):
    first, second = "The first message has a sentence. And another, longer sentence!", "A reply with words of its own."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", second),
        (1, 2, "user", "> A reply with\n> words  OF its own.\nI see it now, thank you."),
        (1, 3, "assistant", "> > And another, longer sentence!\n> I see it now, thank you.\nA late remark about it."),
        (1, 4, "user", "> The first message has a sentence.\nBack to the start."),
        (1, 5, "assistant", "No quote here at all."),
    ]
    got = {r["turn"]: r for r in reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t]["parent_turn"] for t in range(6)] == [None, 0, 1, 2, 0, 4]
    assert [got[t]["depth"] for t in range(6)] == [0, 1, 2, 3, 1, 2]
    assert [got[t]["n_links"] for t in range(6)] == [0, 0, 1, 2, 1, 0]
    assert got[3]["own_text"] == "A late remark about it." and got[3]["quote_depth"] == 2 and got[3]["quoted_lines"] == 2
    assert [got[t]["reply_order"] for t in range(6)] == list(range(6))


def test_short_quotes_find_the_latest_message_that_said_it(spark):
    rows = [
        (1, 0, "user", "Is it safe? I would like to know before we go there."),
        (1, 1, "assistant", "Yes."),
        (1, 2, "user", "这样安全吗？"),
        (1, 3, "assistant", "Yes.\nBut take care of the usual things on the way."),
        (1, 4, "user", "> Is it safe?\nThat was my question."),
        (1, 5, "assistant", "> 这样安全吗？\n是的。"),
        (1, 6, "user", "> Yes.\nGood."),
        (1, 7, "assistant", "> > yes\n> Good.\n!!"),
        (1, 8, "user", "> ...\n> never said\nno original"),
        (1, 9, "user", "> 是的。\n> Good.\ntwo short ones in one block"),
        (2, 0, "user", "> Yes.\nnot of this conversation. Yes."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t]["parent_turn"] for t in range(10)] == [None, 0, 1, 2, 0, 2, 3, 6, 7, 8]
    assert [got[1, t]["n_links"] for t in range(10)] == [0, 0, 0, 0, 1, 1, 1, 2, 0, 0]
    assert got[2, 0]["n_links"] == 0


def test_random_threads_match_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, 1, "user", "> lost\nmessage without a conversation"), (7, None, "user", None), (7, 1, None, ""), (7, 1, None, "")]
    for conv in range(6):
        said = []
        for turn in range(rng.choice([1, 5, 40])):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    lines += ["> " * rng.randint(1, 3) + part for part in rng.choice(said).split("\n")]
                else:
                    lines.append(" ".join(rng.choices(["alpha", "beta", "Gamma", "délta", "the", "end."], k=rng.randint(1, 6))))
            lines += [f"message {conv} number {turn} says {rng.random()}.", rng.choice(["Yes.", "No!", "好的。", "Ok? Fine.", ""])]
            said.append("\n".join(lines))
            rows.append((conv, turn * 700, "user", said[-1]))
    rows += rows[-3:]
    path = folder(tmp_path, conversations=(CONVERSATIONS, rows))
    assert result(op7_quotation_links(spark, path)) == twin(ORACLES[NAME], path, "conversations")


def test_empty_table(spark, tmp_path):
    path = folder(tmp_path, conversations=(CONVERSATIONS, []))
    assert result(op7_quotation_links(spark, path)) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello", "x", 5)], "conv_id long, turn long, role string, text string, passages string, depth int")
    assert reply_ordered(df).count() == 1


def test_second_hash_of_a_passage_reads_the_passage_itself(spark):
    text, one = "a sentence with words", struct.pack("<i", 1)
    row = parsed(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()["passages"][0]
    assert (row["level"], row["brief"]) == (0, False)
    h1, h2 = (row[h] % (1 << 64) for h in ("h1", "h2"))
    assert h1 == xxhash.xxh64_intdigest(text, 42)
    # seeded by the first hash, the second would collide whenever the first does
    assert h2 != xxhash.xxh64_intdigest(one, h1) and h2 == xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(one, 42))


def test_very_long_texts_and_equal_passages(spark):
    long = "\n".join(f"Sentence number {i} of a very long message." for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", long), (1, 2, "user", "> Sentence number 19999 of a very long message.\nYes, that one."),
            (1, 3, "assistant", "> Yes, that one.\nok"), (1, 3, "assistant", "> Yes, that one.\nok")]
    got = reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["parent_turn"], r["n_links"]) for r in got if r["turn"] > 1) == [(2, 0, 1), (3, 2, 1), (3, 2, 1)]
    assert {len(r["own_text"]) for r in got if r["turn"] < 2} == {len(long)}
