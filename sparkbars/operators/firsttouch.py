"""First bar of a forward range that touches a price level.

Bars are summed up (highest high, lowest low) in blocks of ``FAN``, those in blocks of ``FAN`` blocks, and so on. A
search looks at the bars' blocks up to the next block of the level above, at that level's blocks up to the next one of its
own, and so on: at most ``FAN`` summary rows per level, whatever the length of the range. In the first block
that can touch it goes down again, ``FAN`` rows per level. A range of ``m`` bars thus costs about
``2 * FAN * log(m) / log(FAN)`` rows, and all joins are keyed by ``(symbol, level, block)``.

Most touches come early, so a range is first searched over about ``FAN * FAN`` bars; only ranges without
a touch there go on, from the next block on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbars.session import cut

FAN_BITS = 5
FAN = 1 << FAN_BITS

_PROBE = ["symbol", "_first", "_up", "_down"]


def first_touch(
    ranges: DataFrame,
    bars: DataFrame,
    first: str,
    last: str,
    upper: str,
    lower: str,
    longest: int | None = None,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """Add ``touch_pos``, the first bar with high >= upper or low <= lower, and which of both it met.

    ``ranges`` has ``symbol``, inclusive positions ``first`` and ``last`` and the two level
    columns. A NULL level is never touched; an empty range has no touch. ``touch_up`` and
    ``touch_down`` are NULL without a touch. ``longest`` may state the longest range; it saves counting.
    """
    asked = ranges.withColumns({"_first": F.col(first), "_up": F.col(upper), "_down": F.col(lower)})
    # Ranges with the same start and levels share one search over the longest of them.
    probes = asked.filter(F.col(first) <= F.col(last)).groupBy(*_PROBE).agg(F.max(last).alias("_last"))
    near_bars = 1 << (2 * fan_bits)
    if longest is None:
        probes = cut(probes)
        longest = probes.agg(F.max(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    beyond = F.shiftleft(F.shiftright(F.col("_first") + near_bars, fan_bits) + 1, fan_bits)  # where a block starts
    found = _near(probes.withColumn("_last", F.least("_last", beyond - 1)), bars, 1 << fan_bits)
    if longest > near_bars:
        found = cut(found)
        known = found.select(*[F.col(c).alias(f"_k{c}") for c in _PROBE])
        rest = probes.withColumn("_from", beyond).filter("_last >= _from").join(known, _same_probe(), "left_anti")
        found = found.unionByName(_far(rest, bars, fan_bits, longest))
    found = found.select(*[F.col(c).alias(f"_k{c}") for c in _PROBE], "touch_pos", "touch_up", "touch_down")
    reached = F.col("touch_pos") <= F.col(last)
    return asked.join(found, _same_probe(), "left").select(
        *ranges.columns,
        *[F.when(reached, F.col(c)).alias(c) for c in ("touch_pos", "touch_up", "touch_down")],
    )


def _same_probe() -> Column:
    """Join condition of a probe and its copy under ``_k`` names; levels may be NULL."""
    same = F.lit(True)
    for c in _PROBE:
        same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    return same


def _touches() -> Column:
    return (F.col("high") >= F.col("_up")) | (F.col("low") <= F.col("_down"))


def _first_hit(hits: DataFrame) -> DataFrame:
    which = F.struct(
        F.col("_at").alias("touch_pos"),
        F.coalesce(F.col("high") >= F.col("_up"), F.lit(False)).alias("touch_up"),
        F.coalesce(F.col("low") <= F.col("_down"), F.lit(False)).alias("touch_down"),
    )
    return hits.groupBy(*_PROBE).agg(F.min(which).alias("t")).select(*_PROBE, "t.*")


def _blocked(bars: DataFrame, block: int) -> DataFrame:
    return bars.select("symbol", F.expr(f"pos div {block}").alias("_blk"), F.col("pos").alias("_at"), "high", "low")


def _near(probes: DataFrame, bars: DataFrame, block: int) -> DataFrame:
    """Probes that touch between ``_first`` and ``_last``, with the touch; of the blocks wholly inside only the first one that can is opened."""
    blocked = _blocked(bars, block)
    summary = blocked.groupBy(F.col("symbol").alias("_sym"), F.col("_blk").alias("_zone")).agg(
        F.max("high").alias("high"), F.min("low").alias("low")
    )
    spread = probes.withColumn("_blk", F.explode(F.expr(f"sequence(_first div {block}, _last div {block})")))
    # A semi join can only send the summary around, never the exploded ranges, whose size no estimate sees.
    in_zone = (F.col("symbol") == F.col("_sym")) & (F.col("_blk") == F.col("_zone")) & _touches()
    possible = spread.join(summary, in_zone, "left_semi")
    inside = F.expr(f"_blk * {block} >= _first AND (_blk + 1) * {block} - 1 <= _last")
    at_start = F.expr(f"_blk = _first div {block}")
    blk = F.col("_blk")
    opened = possible.groupBy(*_PROBE, "_last").agg(
        F.min(F.when(inside, blk)).alias("_full"),
        F.min(F.when(~inside & at_start, blk)).alias("_start"),
        F.min(F.when(~inside & ~at_start, blk)).alias("_end"),
    )
    # A full block always holds a touch, so the end is looked at only without one.
    wanted = F.array("_start", F.coalesce("_full", "_end"))
    looked = opened.withColumn("_blk", F.explode(F.array_compact(wanted))).drop("_full", "_start", "_end")
    hits = looked.join(blocked, ["symbol", "_blk"]).filter(_touches() & F.col("_at").between(F.col("_first"), F.col("_last")))
    return _first_hit(hits)


def _leveled(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_blk")))


def _far(probes: DataFrame, bars: DataFrame, bits: int, longest: int) -> DataFrame:
    """Probes that touch from ``_from``, the start of a block, to ``_last``, with the touch.

    Level ``k`` has blocks of ``2 ** (bits * k)`` bars, level 0 the bars themselves.
    """
    levels = -(-longest.bit_length() // bits)
    columns = [*_PROBE, "_last"]
    bar_rows = bars.select(F.col("symbol").alias("_sym"), F.col("pos").alias("_zone"), "high", "low")
    tables = [bar_rows]
    for _ in range(levels):
        tables.append(cut(tables[-1].groupBy("_sym", F.shiftright("_zone", bits).alias("_zone")).agg(F.max("high").alias("high"), F.min("low").alias("low"))))
    summary = tables[1].withColumn("_of", F.lit(1))
    for level in range(2, levels + 1):
        summary = summary.unionByName(tables[level].withColumn("_of", F.lit(level)))
    # level 1 up to the next block of level 2, from there level 2 up to the next block of level 3, ...
    spans, start = [], F.shiftright("_from", bits)
    for level in range(1, levels + 1):
        end = F.shiftright("_last", bits * level)
        if level < levels:
            end = F.least(end, F.shiftleft(F.shiftright(start + (1 << bits) - 1, bits), bits) - 1)
        spans.append(F.when(start <= end, _leveled(F.sequence(start, end), level)))
        start = F.shiftright(start + (1 << bits) - 1, bits)
    spread = probes.select(*columns, F.explode(F.flatten(F.array_compact(F.array(*spans)))).alias("_s")).select(*columns, "_s.*")
    in_zone = (F.col("symbol") == F.col("_sym")) & (F.col("_blk") == F.col("_zone")) & _touches()
    up = spread.join(summary, in_zone & (F.col("_level") == F.col("_of")), "left_semi")
    # a lower level lies before a higher one, so the first block that can touch has the least (level, block)
    tops = cut(up.groupBy(*columns).agg(F.min(F.struct("_level", "_blk")).alias("_s")).select(*columns, "_s.*"))
    inside = None
    for level in range(levels, 0, -1):
        here = tops.filter(F.col("_level") == level).drop("_level")
        inside = here if inside is None else here.unionByName(inside)
        children = inside.withColumn("_blk", F.explode(F.expr(f"sequence(_blk * {1 << bits}, (_blk + 1) * {1 << bits} - 1)")))
        if level > 1:
            inside = children.join(tables[level - 1], in_zone, "left_semi").groupBy(*columns).agg(F.min("_blk").alias("_blk"))
    hits = children.join(bar_rows, in_zone).filter(F.col("_blk") <= F.col("_last"))
    return _first_hit(hits.withColumn("_at", F.col("_blk")))
