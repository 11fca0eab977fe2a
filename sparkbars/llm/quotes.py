"""Quotation linking: messages find the message they quote, and conversations lose their quotes.

A line that begins with ``>`` marks is quoted, its level is the number of marks. Neighbouring
lines of one level are a block; the sentences of a block, in lower case and with everything but
letters and digits as blanks, are its passages. A quoted passage of ``MIN_CHARS`` characters or more belongs to the first
message of the conversation whose own text (level 0) holds it, if that came earlier. A quoted block without such a
passage is brief (``> Is it safe?``) and may have been said often: it belongs, as a whole, to the latest earlier message
in which it is a whole sentence or block of the own text. Passages meet by 128 hash bits. A message replies to the
latest message that its level-1 passages belong to; if there is none, to the message before it. Depth counts the
replies back to the first message: runs of unquoting messages need no steps, chains of quoting ones are followed by
pointer doubling.

Everything is DataFrame functions. Originals are reduced to one row per passage before they
are joined, positions and latest places are running values in two levels, so neither a long conversation nor a common
passage has to fit into one task.

Defined results: a NULL text is an empty one; rows with equal conversation and turn share
their place and parent, and a passage of any of them is that turn's; rows without a
conversation or a turn have no parent and depth and order NULL; a passage without letters and digits
links nothing; the control characters U+0001 and U+0002 are dropped; very long texts are read whole; an empty
table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.llm.columns import only
from sparkbars.operators.running import Running, row_index, running
from sparkbars.session import cut

MIN_CHARS = 12
CHUNK_TURNS_BITS = 10
MARKS = r"^[ \t]*(>[ \t]?)+"
BLOCK, FIELD = "\x01", "\x02"


def _lines(text: Column) -> Column:
    clean = F.translate(F.coalesce(text, F.lit("")), BLOCK + FIELD, "")
    return F.transform(
        F.split(clean, "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("content"),
        ),
    )


def _blocks(lines: Column) -> Column:
    """array<struct<level, content>>: neighbouring lines of one level, joined by a blank."""
    marked = F.transform(
        lines,
        lambda line, i: F.concat(
            F.when((i > 0) & (line["level"] == F.get(lines, i - 1)["level"]), F.lit(" ")).otherwise(
                F.concat(F.lit(BLOCK), line["level"].cast("string"), F.lit(FIELD))
            ),
            line["content"],
        ),
    )
    blocks = F.filter(F.split(F.array_join(marked, ""), BLOCK), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(F.substring_index(b, FIELD, 1).cast("int").alias("level"), F.substring_index(b, FIELD, -1).alias("content")),
    )


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(blocks: Column) -> Column:
    """array<struct<level, brief, h1, h2>> of all blocks: long passages, brief blocks, and brief sentences of the own text."""
    split = F.transform(blocks, lambda b: F.struct(
        b["level"].alias("level"),
        F.transform(F.split(F.regexp_replace(b["content"], r"([.!?])\s+", "$1" + BLOCK), BLOCK), _normal).alias("sentences"),
        _normal(b["content"]).alias("whole"),
    ))

    def found(b: Column) -> Column:
        def hashed(texts: Column, brief: bool) -> Column:
            return F.transform(texts, lambda p: F.struct(
                b["level"].alias("level"), F.lit(brief).alias("brief"), F.xxhash64(p).alias("h1"), F.xxhash64(F.lit(1), p).alias("h2")))

        long = F.filter(b["sentences"], lambda p: F.length(p) >= MIN_CHARS)
        short = F.filter(b["sentences"], lambda p: (b["level"] == 0) & (F.length(p) < MIN_CHARS) & (p != ""))
        whole = F.filter(F.array(b["whole"]), lambda p: (F.size(long) == 0) & (p != ""))
        return F.concat(hashed(long, False), hashed(F.concat(short, whole), True))

    return F.array_distinct(F.flatten(F.transform(split, found)))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with own_text, quoted_lines, quote_depth and passages (level, brief, h1, h2)."""
    lines = messages.withColumn("lines", _lines(F.col("text")))
    level = lambda line: line["level"]
    own = F.array_join(F.transform(F.filter("lines", lambda x: level(x) == 0), lambda x: x["content"]), "\n")
    return lines.select(
        "conv_id", "turn", "role", "text",
        F.regexp_replace(own, r"^\s+|\s+$", "").alias("own_text"),
        F.size(F.filter("lines", lambda x: level(x) > 0)).cast("long").alias("quoted_lines"),
        F.array_max(F.transform("lines", level)).cast("long").alias("quote_depth"),
        _passages(_blocks(F.col("lines"))).alias("passages"),
    )


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original): one row per message, quote level and message it quotes."""
    passages = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.explode("passages").alias("p")
    ).select("conv_id", "turn", "p.level", "p.brief", "p.h1", "p.h2")
    key = ["conv_id", "brief", "h1", "h2"]
    quoted = cut(passages.filter("level > 0"))
    wanted = quoted.select(*key).distinct()
    said = cut(passages.filter("level = 0").join(wanted, key, "left_semi").select(*key, "turn").distinct())
    first = cut(said.filter("NOT brief").groupBy(*key).agg(F.min("turn").alias("original")))
    by_first = quoted.join(first, key).filter("original < turn")
    # a quote comes before what its own message says
    order = lambda own: (F.col("turn").cast("decimal(20,0)") * 2 + own).alias("order")
    both = said.filter("brief").select(*key, "turn", order(1), F.lit(None).cast("int").alias("level"), F.col("turn").alias("own")).unionByName(
        quoted.filter("brief").select(*key, "turn", order(0), "level", F.lit(None).cast("long").alias("own")))
    chunked = cut(both.withColumn("chunk", F.shiftright("turn", CHUNK_TURNS_BITS)))
    latest = running(chunked, key, "chunk", "order", [Running("original", "max", F.col("own"))])
    by_latest = latest.filter("level IS NOT NULL AND original IS NOT NULL")
    columns = ["conv_id", "turn", "level", "original"]
    return by_first.select(*columns).unionByName(by_latest.select(*columns)).distinct()


def _resolved(heads: DataFrame) -> DataFrame:
    """(conv_id, turn, depth) of heads (conv_id, turn, up, steps); ``up`` is NULL at the first message."""
    now = cut(heads)
    while not now.filter(F.col("up").isNotNull()).isEmpty():
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"), F.col("steps").alias("more"))
        now = cut(now.join(above, (now["conv_id"] == above["c"]) & (now["up"] == above["t"]), "left").select(
            "conv_id", "turn", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        ))
    return now.select("conv_id", "turn", F.col("steps").alias("depth"))


def reply_ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message without its quotes, with the turn it replies to, its depth and its place in the conversation.

    Columns: conv_id, turn, role, own_text, quoted_lines, quote_depth, n_links, parent_turn, depth, reply_order.
    A parent always comes before its replies.
    """
    named = only(conversations, conv_id, turn, role, text).toDF("conv_id", "turn", "role", "text")
    messages = cut(parsed(named))
    found = links(messages.select("conv_id", "turn", "passages"))
    linked = cut(found.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("original"))).alias("quoted_turn"), F.countDistinct("original").alias("n_links")
    ))
    turns = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    chunked = cut(turns.join(linked, ["conv_id", "turn"], "left").withColumn("chunk", F.shiftright("turn", CHUNK_TURNS_BITS)))
    placed = row_index(chunked, ["conv_id"], "chunk", ["turn"], "reply_order", sizes_from=chunked)
    before = cut(running(placed, ["conv_id"], "chunk", "turn", [Running("previous", "max", F.col("turn"))], exclusive=True))
    is_head = F.col("quoted_turn").isNotNull() | F.col("previous").isNull()
    headed = cut(running(before, ["conv_id"], "chunk", "turn", [Running("head", "max", F.when(is_head, F.col("turn")))]))
    parent = headed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("head").alias("above"), F.col("reply_order").alias("place"))
    order_of = headed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("reply_order").alias("head_place"))
    parent = parent.join(order_of.withColumnsRenamed({"c": "c2", "t": "t2"}), (F.col("c") == F.col("c2")) & (F.col("above") == F.col("t2"))).select(
        "c", "t", "above", (F.col("place") - F.col("head_place") + 1).alias("gap")
    )
    jumps = headed.filter(is_head)
    heads = jumps.join(parent, (jumps["conv_id"] == parent["c"]) & (jumps["quoted_turn"] == parent["t"]), "left").select(
        "conv_id", "turn", F.col("above").alias("up"), F.coalesce("gap", F.lit(0)).cast("long").alias("steps")
    )
    depths = _resolved(heads).withColumnsRenamed({"conv_id": "c", "turn": "t", "depth": "head_depth"})
    deep = headed.join(depths, (headed["conv_id"] == depths["c"]) & (headed["head"] == depths["t"])).join(
        order_of.withColumnsRenamed({"c": "c2", "t": "t2"}), (F.col("conv_id") == F.col("c2")) & (F.col("head") == F.col("t2"))
    ).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce("quoted_turn", "previous").alias("parent_turn"),
        (F.col("head_depth") + F.col("reply_order") - F.col("head_place")).alias("depth"), "reply_order",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    deep = cut(deep)
    return messages.join(deep, (messages["conv_id"] == deep["c"]) & (messages["turn"] == deep["t"]), "left").select(
        "conv_id", "turn", "role", "own_text", "quoted_lines", "quote_depth", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "parent_turn", "depth", "reply_order",
    )
