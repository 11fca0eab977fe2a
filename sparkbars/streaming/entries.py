"""Entry decisions bar by bar: channel state, signal, size, one open order at a time.

Two keyed steps with plain columns between them. The first keeps the newest bars of a
symbol and emits every bar with its channels; signal, features, score and size are the
same column definitions the batch jobs use; the second lets one entry through and
waits until the position is reported closed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkbars.functions.signals import last_bar_signal, stop_level
from sparkbars.functions.sizing import risk_size
from sparkbars.streaming.state import sorted_rows, use_state_store

# States of the entry decision.
IDLE, WAITING_CLOSE = "IDLE", "WAITING_CLOSE"

_CHANNELS = ["entry_high", "entry_low", "exit_high", "exit_low", "atr"]
_BAR_SCHEMA = (
    "symbol string, pos long, open_time long, high double, low double, close double, "
    "entry_high double, entry_low double, exit_high double, exit_low double, atr double, late_bars long"
)
_EDGES = ["entry_high", "entry_low", "exit_high", "exit_low"]
_STATE_SCHEMA = (
    "last long, next_pos long, late long, close double, total double, rest double, no_high long, no_low long, no_range long, "
    + ", ".join(f"{e}_at array<long>, {e}_value array<double>" for e in _EDGES)
)
RANGE_BLOCK = 64  # bars whose ranges are kept together


@dataclass(frozen=True)
class Rule:
    entry_period: int = 20
    exit_period: int = 10
    atr_period: int = 20
    atr_mult: float = 2.0
    intensity_threshold: float = 0.0


class Edge:
    """Highest (sign 1) or lowest (sign -1) value of the bars before, as the few of them that can still become it."""

    def __init__(self, period: int, sign: int, at=(), values=()):
        self.period, self.sign, self.kept = period, sign, deque(zip(at, values))

    def before(self, pos: int, missing: int) -> float | None:
        while self.kept and self.kept[0][0] < pos - self.period:
            self.kept.popleft()
        return self.kept[0][1] if pos >= self.period and missing < pos - self.period else None

    def push(self, pos: int, value: float) -> None:
        while self.kept and self.kept[-1][1] * self.sign <= value * self.sign:
            self.kept.pop()
        self.kept.append((pos, value))

    def lists(self) -> tuple[list, list]:
        return [at for at, _ in self.kept], [value for _, value in self.kept]


class Ranges:
    """Sum of the ranges of the last bars, with its rounding error; the ranges themselves lie in blocks in a map state."""

    def __init__(self, period: int, state, total: float, rest: float):
        self.period, self.state, self.total, self.rest = period, state, total, rest
        self.blocks: dict[int, list[float]] = {}

    def _block(self, number: int) -> list[float]:
        if number not in self.blocks:
            self.blocks[number] = list(self.state.getValue((number,))[0]) if self.state.containsKey((number,)) else []
        return self.blocks[number]

    def _add(self, value: float) -> None:
        total = self.total + value
        part = total - self.total
        self.rest += (self.total - (total - part)) + (value - part)
        self.total = total

    def push(self, pos: int, value: float) -> None:
        """Takes in the range of a bar, and lets go the one that leaves the window."""
        self._block(pos // RANGE_BLOCK).append(value)
        self._add(value)
        gone = pos - self.period
        if gone >= 0:
            self._add(-self._block(gone // RANGE_BLOCK)[gone % RANGE_BLOCK])
            if gone % RANGE_BLOCK == RANGE_BLOCK - 1:
                self.blocks.pop(gone // RANGE_BLOCK)
                if self.state.containsKey((gone // RANGE_BLOCK,)):
                    self.state.removeKey((gone // RANGE_BLOCK,))

    def mean(self) -> float:
        return (self.total + self.rest) / self.period

    def store(self, pos: int) -> None:
        """Only blocks that grew are written."""
        for number, values in self.blocks.items():
            if number >= self.stored:
                self.state.updateValue((number,), (values,))

    stored = 0


class ChannelState(StatefulProcessor):
    """What the channels of a symbol need of its past; every new closed bar comes out with its channels.

    Highest and lowest values are queues of the bars that can still become one, the range is a running sum, so a
    call reads and writes a few values and not the window, whatever its length. A bar not newer than the last one is
    dropped and counted. The rows of a symbol in one trigger are sorted in memory; the source bounds them.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("channels", _STATE_SCHEMA)
        self.ranges = handle.getMapState("ranges", "block long", "values array<double>")

    def _advance(self, symbol, frames) -> pd.DataFrame:
        rule = self.rule
        last, pos, late, close, total, rest, no_high, no_low, no_range, *kept = (
            self.state.get() if self.state.exists() else (-(2**62), 0, 0, None, 0.0, 0.0, -1, -1, -1, *[()] * 8)
        )
        periods = [rule.entry_period, rule.entry_period, rule.exit_period, rule.exit_period]
        edges = [Edge(p, sign, kept[2 * i], kept[2 * i + 1]) for i, (p, sign) in enumerate(zip(periods, (1, -1, 1, -1)))]
        ranges = Ranges(rule.atr_period, self.ranges, total, rest)
        ranges.stored = pos // RANGE_BLOCK
        out = []
        for at, high, low, now in sorted_rows(frames, ["open_time", "high", "low", "close"], ["open_time"]):
            if at is None or at <= last:
                late += 1
                continue
            last = at
            found = [e.before(pos, no_high if i % 2 == 0 else no_low) for i, e in enumerate(edges)]
            atr = ranges.mean() if pos >= rule.atr_period and no_range < pos - rule.atr_period else None
            out.append((symbol, pos, at, high, low, now, *found, atr))
            spread = [v for v in (_minus(high, low), _apart(high, close), _apart(low, close)) if v is not None]
            if spread:
                ranges.push(pos, max(spread))
            else:
                no_range = pos
                ranges.push(pos, 0.0)
            if high is None:
                no_high = pos
            if low is None:
                no_low = pos
            for i, e in enumerate(edges):
                if (value := low if i % 2 else high) is not None:
                    e.push(pos, value)
            close, pos = now, pos + 1
        ranges.store(pos)
        lists = [x for e in edges for x in e.lists()]
        self.state.update((last, pos, late, close, ranges.total, ranges.rest, no_high, no_low, no_range, *lists))
        names = [f.split()[0] for f in _BAR_SCHEMA.split(", ")]
        table = pd.DataFrame(out, columns=names[:-1])
        table[names[3:-1]] = table[names[3:-1]].astype("float64")
        return table.assign(late_bars=late)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._advance(key[0], [initialState])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self._advance(key[0], rows)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def _minus(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a - b


def _apart(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else abs(a - b)


def stream_channels(bars: DataFrame, rule: Rule, history: DataFrame | None = None, delay: str | None = None) -> DataFrame:
    """Closed bars with channels. ``history`` holds bars known before the stream starts.

    With ``delay``, an interval such as "10 minutes", bars of a symbol and time that were seen within it are dropped
    before they reach the state, and so are those later than it; ``run_counted`` reports how many.
    """
    use_state_store(bars.sparkSession)
    columns = ["symbol", "open_time", "high", "low", "close"]
    initial = None if history is None else history.select(*columns).groupBy("symbol")
    if delay is not None:
        bars = bars.withColumn("_clock", F.timestamp_millis("open_time")).withWatermark("_clock", delay)
        bars = bars.dropDuplicatesWithinWatermark(["symbol", "open_time"])
    return bars.select(*columns).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=ChannelState(rule), outputStructType=_BAR_SCHEMA, outputMode="Append",
        timeMode="None", initialState=initial,
    )


_ENTRY_SCHEMA = (
    "symbol string, pos long, open_time long, side int, entry_price double, stop_price double, size double, score double"
)


class EntryGate(StatefulProcessor):
    """IDLE until an entry passes, then WAITING_CLOSE until the position is reported closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mode = handle.getValueState("mode", "mode string")

    def handleInputRows(self, key, rows, timerValues):
        mode = self.mode.get()[0] if self.mode.exists() else IDLE
        names = [f.split()[0] for f in _ENTRY_SCHEMA.split(", ")]
        passed = []
        # A close reported at a bar's time takes effect before that bar.
        for closing, *row in sorted_rows(rows, ["is_close", *names], ["open_time", "is_close"], [True, False]):
            if closing:
                mode = IDLE
            elif mode == IDLE:
                passed.append(row)
                mode = WAITING_CLOSE
        self.mode.update((mode,))
        if passed:
            yield pd.DataFrame(passed, columns=names)

    def close(self) -> None:
        pass


def entry_candidates(
    channels: DataFrame, rule: Rule, size: Column, allowed: Column | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.0,
) -> DataFrame:
    """Entry signals that pass the risk gate, the score and the size; plain columns, batch or stream."""
    args = [F.col(c) for c in ("close", *_CHANNELS)]
    rows = channels.withColumn("side", last_bar_signal(*args, rule.intensity_threshold))
    ready = F.col("pos") >= max(rule.entry_period, rule.atr_period)
    rows = rows.filter(ready & (F.abs("side") == 1)).withColumn(
        "stop_price", stop_level(F.col("side"), F.col("close"), F.col("atr"), rule.atr_mult)
    ).filter(F.col("stop_price").isNotNull())
    if allowed is not None:
        rows = rows.filter(allowed)
    if score is not None:
        rows = score(rows).filter(F.col("score") > threshold)
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    return rows.withColumn("size", size).filter(F.col("size") > 0)


def stream_entries(
    bars: DataFrame,
    closes: DataFrame,
    rule: Rule,
    balance: float = 10_000.0,
    history: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Entries of a bar stream. ``closes`` (symbol, open_time) reports closed positions."""
    size = risk_size(F.lit(balance), F.col("close"), F.col("stop_price"))
    candidates = entry_candidates(stream_channels(bars, rule, history), rule, size, **options).select(
        "symbol", "pos", "open_time", F.col("side").cast("int").alias("side"),
        F.col("close").alias("entry_price"), "stop_price", "size", "score", F.lit(False).alias("is_close"),
    )
    closed = closes.select("symbol", "open_time", F.lit(True).alias("is_close"))
    both = candidates.unionByName(closed, allowMissingColumns=True)
    return both.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=EntryGate(), outputStructType=_ENTRY_SCHEMA, outputMode="Append", timeMode="None"
    )
