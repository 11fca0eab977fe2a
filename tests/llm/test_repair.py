"""Conversation repair against its SQL twin, a cheapest-path search and hand-made cases."""

import heapq
import random
from hashlib import sha256

import pytest

from sparkbars.llm import repair
from sparkbars.llm.queries import ORACLES, op11_conversation_repair
from tests.llm.helpers import CONVERSATIONS, folder, result, twin

NAME = "op11_conversation_repair"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(marks):
    """Cheapest (cost, edits) over (rows read, place), smallest first."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, place = heapq.heappop(heap)
        if i == len(marks) and place in (0, 3):
            return cost, edits
        if (i, place) in done:
            continue
        done.add((i, place))
        grow = {0: 2, 1: 2, 2: 3, 3: 2}[place]
        heapq.heappush(heap, (cost + 5, edits + "I", i, grow))
        if i < len(marks):
            initial, fault = marks[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, place))
            if fault not in (repair.BLANK, repair.REPEATED):
                more = 5 * (fault == repair.CUT_OFF)
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, grow))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((place, initial))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, kept))


def test_search_finds_the_first_of_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(3000):
        marks = [(rng.choice("suat" if rng.random() < 0.9 else ["", "U"]), rng.choice([0, 1, 2, 3, 3, 3, 3])) for _ in range(rng.randint(0, 12))]
        assert repair.Search(marks).best() == plain(marks)


def test_search_reaches_every_goal_or_says_that_it_cannot():
    rng = random.Random(2)
    for _ in range(500):
        marks = [(rng.choice("suat"), rng.choice([0, 2, 3, 3])) for _ in range(rng.randint(1, 6))]
        for goal in repair.PLACES:
            search = repair.Search(marks, goal)
            for start in repair.PLACES:
                found = search.best(start)
                assert found == repair.Search(marks, goal).best(start)  # a table used before says the same
                if found is None:
                    assert goal < 2 and (start > goal or start < goal and not any(c == "s" and f >= 2 for c, f in marks))


def test_long_conversation_stays_cheap():
    rng = random.Random(3)
    marks = [(rng.choice("ua"), rng.choice([0, 1, 2, 3, 3, 3])) for _ in range(repair.SEGMENT_ROWS)]
    assert repair.Search(marks).best() == plain(marks)


def conversations(rng):
    rows = [(None, None, None, None), (None, 2, "user", "a."), (900, 5, "user", None), (901, 0, "system", ""), (901, 1, "", "x.")]
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice([("user", "assistant")[turn % 2]] * 6 + ["system", "tool", None])
            text = rng.choice(["So it is.", "Yes!", "no end", " \t", "Wéll, 好的?", "é", f"number {rng.random()}.", f"long {'word ' * 400}."])
            rows.append((conv, rng.choice([turn] * 8 + [turn + 3, None, -turn]), role, text))
    return rows + rows[-7:]


@pytest.mark.parametrize("size", [128, 3, 1])
def test_random_conversations_match_sql_whatever_the_segments(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", size)
    path = folder(tmp_path, conversations=(CONVERSATIONS, conversations(random.Random(4))))
    got = result(op11_conversation_repair(spark, path))
    assert got == twin(ORACLES[NAME], path, "conversations") and len(got) == 63


def test_pieces_hold_the_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 4)
    rows = repair.damaged(spark.createDataFrame(conversations(random.Random(5)), SCHEMA))
    pieces = repair.edited(rows).orderBy("conv_id", "part", "began").collect()
    said, told = {}, {}
    for p in pieces:
        said.setdefault(p["conv_id"], []).extend(p["repaired"])
        if p["result"] is not None:
            assert p["conv_id"] not in told
            told[p["conv_id"]] = p["result"]["repaired_sha256"]
    assert told == {k: sha256("\n".join(v).encode()).hexdigest() for k, v in said.items()}
    assert len(pieces) > len(told) and all(s[:1] in "sua" for v in said.values() for s in v)


def test_by_hand(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 3, "assistant", "Yes"), (2, 0, "assistant", "Alone.")]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the cut-off answer is better deleted (2) than kept (5): two rows remain and one becomes the answer
    assert (got[1]["audit"], got[1]["cost"], got[1]["gaps"], got[1]["illegal"], got[1]["truncated"]) == ("KRD", 3, 1, 1, 1)
    assert got[1]["repaired_sha256"] == sha256(b"user:Hi.\nassistant:There.").hexdigest()
    assert (got[2]["audit"], got[2]["cost"], got[2]["illegal"]) == ("D", 2, 0)
    assert got[2]["repaired_sha256"] == sha256(b"").hexdigest()


def test_empty_table_extra_columns_and_very_long_text(spark, tmp_path):
    path = folder(tmp_path, conversations=(CONVERSATIONS, []))
    assert result(op11_conversation_repair(spark, path)) == []
    names = ["conv_id", "turn", "role", "text", "part", "began", "rows", "result", "tie", "its_part"]
    wide = [(7, 0, "user", "x" * 3_000_000 + ".", 1, 1, 1, 1, 1, 1), (7, 1, "assistant", "y.", 1, 1, 1, 1, 1, 1)]
    row = repair.repair(spark.createDataFrame(wide, names)).first()
    assert row["audit"] == "KK" and row["repaired_sha256"] == sha256(b"user:" + b"x" * 3_000_000 + b".\nassistant:y.").hexdigest()
