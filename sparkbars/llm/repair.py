"""Structure repair of conversations: the cheapest edits that make their roles legal.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Rows are kept (0), given the
role user or assistant (1) or deleted (2, the only way with blank and repeated rows); empty rows may be inserted
(5); a truncated row that stays costs 5 more. Of the cheapest edit lists the first in ASCII order wins.

Search is iterative-deepening A*: a depth-first search that tries edits in ASCII order under a cost
bound, with the bound raised to the least cost that exceeded it. A state is (rows read, place in the
pattern). The transposition table holds, for every state that failed, the least that it still needs; it starts
with two for every faulty row ahead. The first accepting path is the answer.

Rows are dealt out by ranges of (conversation, turn, role, text) and read in runs. A conversation that lies
in one run of at most ``SEGMENT_ROWS`` rows is solved there. Others, a conversation of any length included,
are cut into segments: each is searched in a task of its own from every place in the pattern to every other, the
costs are chained over one small row per segment, and the digest of the repaired rows, which has to read them in order,
streams over the segments. Rows that repeat an earlier one are found by a join on digests, for these conversations only.

Defined results: NULL role and text are one space; NULL turns come first; rows of one turn are ordered by
role and text; NULL is a conversation like others; an empty role has no initial and cannot be kept; very long texts
are never cut; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkbars.llm.columns import only
from sparkbars.llm.ordering import ranged
from sparkbars.session import cut

SEGMENT_ROWS = 128
BATCH_CHARS = 1 << 22
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\v\f\r"
BLANK, REPEATED, CUT_OFF, FINE = range(4)
START, AFTER_SYSTEM, AFTER_USER, CLOSED = PLACES = range(4)
KEPT = {START: {"s": AFTER_SYSTEM, "u": AFTER_USER}, AFTER_SYSTEM: {"u": AFTER_USER}, AFTER_USER: {"a": CLOSED}, CLOSED: {"u": AFTER_USER}}
NEXT = {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_USER: CLOSED, CLOSED: AFTER_USER}
ROLE = {AFTER_USER: "user", CLOSED: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
ENDING = {START: "", AFTER_SYSTEM: "II", AFTER_USER: "I", CLOSED: ""}  # what closes a conversation
NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows`` with the faults that crc32 of ``conv_id:turn`` plants; dropped rows keep a place without role."""
    named = only(rows, "conv_id", "turn", "role", "text")
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    faulty = named.select(
        "conv_id", "turn", F.when(fault == 4, "user").when(fault != 0, role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).when(fault != 0, text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return faulty.drop("copy")


def fault_of(text: str, repeated: bool) -> int:
    last = text.rstrip(BLANKS)[-1:]
    return BLANK if not last else REPEATED if repeated else FINE if last in ".!?" else CUT_OFF


class Search:
    """Cheapest edits of ``rows`` (initial, fault) to the place ``goal``, or with ``goal`` None to a legal end."""

    def __init__(self, rows: list[tuple[str, int]], goal: int | None = None):
        self.rows, self.goal = rows, goal
        ahead = [0]
        for _, fault in reversed(rows):
            ahead.append(ahead[-1] + (0 if fault == FINE else DELETE))
        ahead.reverse()
        # the transposition table: the least that is still to pay, raised whenever a state fails
        self.least = [[n] * len(PLACES) for n in ahead]
        if goal in (START, AFTER_SYSTEM):
            system = max((i for i, (c, fault) in enumerate(rows) if c == "s" and fault >= CUT_OFF), default=-1)
            for i, row in enumerate(self.least):
                for place in PLACES:
                    if place > goal or place < goal and i > system:
                        row[place] = NEVER
        self.path: list[str] = []

    def accepts(self, place: int) -> bool:
        return place == self.goal if self.goal is not None else place in (START, CLOSED)

    def moves(self, i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, row, place) in ASCII order of the edits."""
        inside = i < len(self.rows)
        if inside:
            yield "D", DELETE, i + 1, place
        if inside or self.goal is None:
            yield "I", INSERT, i, NEXT[place]
        if inside:
            initial, fault = self.rows[i]
            if fault >= CUT_OFF:
                more = TRUNCATED if fault == CUT_OFF else 0
                kept = KEPT[place].get(initial)
                if kept is not None:
                    yield "K", more, i + 1, kept
                if kept != NEXT[place]:
                    yield "R", RETYPE + more, i + 1, NEXT[place]

    def reaches(self, i: int, place: int, left: int) -> bool:
        if i == len(self.rows) and self.accepts(place):
            return True
        cheapest = NEVER
        for edit, cost, row, then in self.moves(i, place):
            need = cost + self.least[row][then]
            if need <= left:
                self.path.append(edit)
                if self.reaches(row, then, left - cost):
                    return True
                self.path.pop()
                need = cost + self.least[row][then]
            cheapest = min(cheapest, need)
        self.least[i][place] = max(self.least[i][place], cheapest)
        return False

    def best(self, start: int = START) -> tuple[int, str] | None:
        """(cost, edits), None where the goal cannot be reached."""
        self.path.clear()
        while (bound := self.least[0][start]) < NEVER:
            if self.reaches(0, start, bound):
                return bound, "".join(self.path)
        return None


def repaired(rows: list[tuple[str, str]], edits: str, place: int) -> list[str]:
    """``role:text`` of every row that the edits leave, from a place in the pattern on."""
    out, at = [], iter(rows)
    for edit in edits:
        if edit == "I":
            place = NEXT[place]
            out.append(f"{ROLE[place]}:")
            continue
        role, text = next(at)
        if edit == "K":
            place = KEPT[place][role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            place = NEXT[place]
            out.append(f"{ROLE[place]}:{text}")
    return out


def counted(rows: list[tuple[int | None, str, str]], faults: list[int]) -> dict:
    """Counts of a run of rows (turn, role, text), with what is needed to join it to its neighbours."""
    initials, turns = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(CUT_OFF),
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
        "turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns),
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
    }


COUNTS = "blank long, duplicate long, truncated long, illegal long"
RESULT = f"gaps long, {COUNTS}, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<turn:long,role:string,text:string>>"


def outcome(counts: dict, cost: int, audit: str, sha: str) -> dict:
    gaps = counts["high"] - counts["low"] + 1 - counts["turns"] if counts["turns"] else 0
    values = (gaps, *[counts[c] for c in ("blank", "duplicate", "truncated", "illegal")], cost, audit, sha)
    return dict(zip([f.split()[0] for f in RESULT.split(", ")], values))


def solved(rows: list[tuple[int | None, str, str]]) -> tuple[dict, list[str]]:
    """The result of one whole conversation and its repaired rows."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = Search([(r[1][:1], f) for r, f in zip(rows, faults)]).best()
    lines = repaired([r[1:] for r in rows], audit, START)
    return outcome(counted(rows, faults), cost, audit, sha256("\n".join(lines).encode()).hexdigest()), lines


def _runs(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[object, int, list[dict], bool]]:
    """(conversation, number of its first row, rows, whole) for neighbouring rows of one conversation, at most ``limit`` at a time."""
    at, key, rows, began, first = 0, None, [], None, True
    for batch in batches:
        for row in batch.to_pylist():
            if began is not None and (row["conv_id"] != key or limit and len(rows) == limit):
                new = row["conv_id"] != key
                yield key, began, rows, new and not first
                # what goes on after a full segment is no whole conversation, nor is the first one of a partition
                first, rows, began = not new, [], None
            if began is None:
                key, began = row["conv_id"], at
            rows.append(row)
            at += 1
    if began is not None:
        yield key, began, rows, False


def _cutter(kind: str) -> tuple:
    """A function from sorted rows to solved conversations and segments of the others, and its schema."""
    schema = T.StructType.fromDDL(f"conv_id {kind}, part int, began long, result struct<{RESULT}>, repaired array<string>, rows {ROWS}")
    arrow = to_arrow_schema(schema)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        for key, began, rows, whole in _runs(batches, SEGMENT_ROWS):
            rows = [(r["turn"], r["role"], r["text"]) for r in rows if r["role"] is not None]
            result, lines = solved(rows) if whole else (None, None)
            kept = None if whole else [dict(zip(("turn", "role", "text"), r)) for r in rows]
            out.append({"conv_id": key, "part": part, "began": began, "result": result, "repaired": lines, "rows": kept})
            size += 1000 + sum(len(r[2]) for r in rows)
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, arrow)

    return cut_up, schema


WAY = "struct<cost:long,audit:string>"
SEGMENT = f"{COUNTS}, turns long, low long, high long, first string, last string, ways array<{WAY}>, faults binary"


def searched(rows, repeats):
    """Counts of a segment and its cheapest edits from every place to every place (row-major, NULL where there are none)."""
    rows, again = [tuple(r) for r in rows or []], set(repeats or [])
    faults = [fault_of(text, k in again) for k, (_, _, text) in enumerate(rows)]
    marks = [(r[1][:1], f) for r, f in zip(rows, faults)]
    ways: list = [None] * 16
    for goal in PLACES:
        search = Search(marks, goal)
        for start in PLACES:
            ways[4 * start + goal] = search.best(start)
    return (*counted(rows, faults).values(), ways, bytes(faults))


def row_digests(rows):
    """Digests of (role, text), which meet where a row repeats another one."""
    return [md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest() for r in rows or []]


def _costs_to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For segments read from the last to the first: what each place still costs after the segment."""
    key, began, after = None, False, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not began or row["conv_id"] != key:
                key, began, after = row["conv_id"], True, [INSERT * len(ENDING[p]) for p in PLACES]
            out.append(after)
            costs = [NEVER if w is None else w for w in row["costs"]]
            after = [min(min(costs[4 * s + g] + after[g] for g in PLACES), NEVER) for s in PLACES]
        names = ["conv_id", "part", "began"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.list_(pa.int64()))], [*names, "after"])


def _chainer(kind: str) -> tuple:
    """A function from segments in order to their repaired rows, the last one of a conversation with its result, and its schema."""
    schema = T.StructType.fromDDL(f"conv_id {kind}, part int, began long, result struct<{RESULT}>, repaired array<string>")
    arrow = to_arrow_schema(schema)
    faults = ("blank", "duplicate", "truncated", "illegal")

    def fresh() -> dict:
        counts = dict.fromkeys((*faults, "turns", "cost"), 0)
        return counts | {"low": None, "high": None, "last": None, "place": START, "hash": sha256(), "audit": []}

    def say(now: dict, out: dict, lines: list[str]) -> None:
        for line in lines:
            now["hash"].update((b"\n" if now.get("said") else b"") + line.encode())
            now["said"] = True
        out["repaired"] += lines

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or row["conv_id"] != out["conv_id"]:
                    if out is not None:
                        yield pa.RecordBatch.from_pylist([ended(now, out)], arrow)
                    now = fresh()
                else:
                    yield pa.RecordBatch.from_pylist([out], arrow)
                out = {"conv_id": row["conv_id"], "part": row["part"], "began": row["began"], "result": None, "repaired": []}
                found, after = row["found"], row["after"]
                for c in faults:
                    now[c] += found[c]
                if found["turns"]:
                    now["turns"] += found["turns"] - (found["low"] == now["high"])
                    now["low"], now["high"] = found["low"] if now["low"] is None else now["low"], found["high"]
                if found["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + found["first"] not in LEGAL_PAIRS
                    now["last"] = found["last"]
                # edits of a segment end with its last row, so none of these lists is the beginning of another
                ways = found["ways"][len(PLACES) * now["place"] :][: len(PLACES)]
                _, audit, goal = min((w["cost"] + after[g], w["audit"], g) for g, w in zip(PLACES, ways) if w is not None)
                say(now, out, repaired([(r["role"], r["text"]) for r in row["rows"]], audit, now["place"]))
                now["cost"] += ways[goal]["cost"]
                now["audit"].append(audit)
                now["place"] = goal
        if out is not None:
            yield pa.RecordBatch.from_pylist([ended(now, out)], arrow)

    def ended(now: dict, out: dict) -> dict:
        end = ENDING[now["place"]]
        say(now, out, repaired([], end, now["place"]))
        return out | {"result": outcome(now, now["cost"] + INSERT * len(end), "".join(now["audit"]) + end, now["hash"].hexdigest())}

    return chain, schema


def edited(rows: DataFrame) -> DataFrame:
    """(conv_id, part, began, repaired, result): every conversation of ``rows`` (conv_id, turn, role, text) in one or more pieces.

    ``repaired`` holds the piece's ``role:text`` rows; pieces are ordered by part and began. One piece of a
    conversation, the last one, has the ``result`` of all. A row without a role holds no place but names its conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut_up, schema = _cutter(kind)
    digests = F.udf(row_digests, "array<string>", useArrow=True)
    search = F.udf(searched, f"struct<{SEGMENT}>", useArrow=True)
    typed = only(rows, "conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("long"))
    runs = cut(ranged(typed, ["conv_id", "turn", "role", "text"]).mapInArrow(cut_up, schema))
    solved_here = runs.filter("rows IS NULL").drop("rows")
    place = ["conv_id", "part", "began"]
    pieces = runs.filter("rows IS NOT NULL").select(*place, "rows")
    marks = cut(pieces.select(*place, F.posexplode(digests("rows")).alias("at", "digest")))
    order = F.struct("part", "began", "at")
    firsts = marks.groupBy(F.col("conv_id").alias("its_conv"), F.col("digest").alias("its_digest")).agg(F.min(order).alias("earliest"))
    again = marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest"))).filter(order > F.col("earliest"))
    again = again.groupBy(F.col("part").alias("its_part"), F.col("began").alias("its_began")).agg(F.collect_list("at").alias("repeats"))
    here = (F.col("part") == F.col("its_part")) & (F.col("began") == F.col("its_began"))
    found = cut(pieces.join(again, here, "left").select(*place, "rows", search("rows", "repeats").alias("found")))
    costs = found.select(*place, F.transform("found.ways", lambda w: w["cost"]).alias("costs"))
    last_first = [F.col("conv_id"), F.col("part").desc(), F.col("began").desc()]
    ends = costs.repartition("conv_id").sortWithinPartitions(*last_first).mapInArrow(
        _costs_to_end, f"conv_id {kind}, part int, began long, after array<long>")
    ends = ends.select(F.col("part").alias("its_part"), F.col("began").alias("its_began"), "after")
    chain, schema = _chainer(kind)
    joined = found.join(ends, here).drop("its_part", "its_began")
    return solved_here.unionByName(joined.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(chain, schema))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts of faults, cost and audit of the cheapest edits, digest of the repaired rows."""
    return edited(rows).filter("result IS NOT NULL").select("conv_id", "result.*")
