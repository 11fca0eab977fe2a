"""Rolling windows of any length over bars.

Bars are dealt into chunks of consecutive positions, and each chunk also receives
the last ``lookback`` bars before it (its halo). All windows then run inside
``(symbol, chunk)``: one shuffle serves every indicator and period, groups are
bounded, and a symbol with a long history is spread over many tasks.

Windows up to ``PLAIN_LIMIT`` rows use Spark's own sliding frame. It re-aggregates the frame for every
row, and chains of ``lag`` steps that avoid this copy every row once per step, so longer windows
leave the row format: a group's columns travel to numpy once, where windows of 1, 2, 4, ... rows are put together from
two halves each. All periods share these steps, the shuffle and the sort, and a window of ``p`` rows costs ``log2(p)``
additions of whole columns. A group holds at most a chunk and its halo.

A spread is carried as a mean and the squared distance from it, so nothing cancels: a standard deviation
depends neither on where a chunk begins nor on the level of the series, and agrees with that of a plain frame within
a relative error of 1e-9 where the series itself is resolved that far (its level is less than a million times its spread).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_LIMIT = 64
CHUNK_ROWS = 65_536
_CHUNK = "_chunk"


@dataclass(frozen=True)
class Roll:
    """``how`` is max, min, sum, avg or std (population) of ``value`` over ``period`` bars.

    The window ends at the previous bar unless ``current`` is set. The result is NULL
    until ``period`` values that are not NULL exist.
    """

    out: str
    how: str
    value: str
    period: int
    current: bool = False

    @property
    def shift(self) -> int:
        return 0 if self.current else 1


class HaloFrame:
    """Bars dealt into overlapping chunks; columns are added until ``core()`` is taken."""

    def __init__(self, bars: DataFrame, lookback: int, chunk_rows: int | None = None):
        self.rows = max(chunk_rows or CHUNK_ROWS, 1)
        pos = F.col("pos")
        first, last = F.floor(pos / self.rows), F.floor((pos + lookback) / self.rows)
        self.df = bars.withColumn(_CHUNK, F.explode(F.sequence(first, last)))

    @staticmethod
    def _ordered():
        return W.partitionBy("symbol", _CHUNK).orderBy("pos")

    def with_columns(self, columns: dict[str, Column]) -> "HaloFrame":
        self.df = self.df.withColumns(columns)
        return self

    def lagged(self, value: str, k: int) -> Column:
        return F.lag(value, k).over(self._ordered())

    def over_chunk(self, value: Column) -> Column:
        return value.over(W.partitionBy("symbol", _CHUNK))

    def roll(
        self, rolls: Sequence[Roll], plain_limit: int = PLAIN_LIMIT, ratios: Mapping[str, tuple[str, str]] | None = None
    ) -> "HaloFrame":
        """Adds the rolls. ``ratios`` names quotients of two columns, rolls included, that rolls may read; one divided by 0 is NULL.

        Halo copies may be gone afterwards where long windows were computed, so ask for all rolls at once.
        """
        ratios = dict(ratios or {})
        long = {r.out for r in rolls if r.period > plain_limit}
        late = {n for n, parts in ratios.items() if long & set(parts)}
        plain = [r for r in rolls if r.out not in long and r.value not in ratios]
        self.df = self.df.withColumns({r.out: self._plain(r) for r in plain}) if plain else self.df
        self.df = self.df.withColumns({n: F.try_divide(*parts) for n, parts in ratios.items() if n not in late})
        plain = [r for r in rolls if r.out not in long and r.value in ratios and r.value not in late]
        self.df = self.df.withColumns({r.out: self._plain(r) for r in plain}) if plain else self.df
        rest = [r for r in rolls if r.out in long or r.value in late]
        if rest:
            self._long(rest, {n: ratios[n] for n in late})
        return self

    def _plain(self, r: Roll) -> Column:
        frame = self._ordered().rowsBetween(-r.period + 1 - r.shift, -r.shift)
        how = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "std": F.stddev_pop}[r.how]
        return F.when(F.count(r.value).over(frame) == r.period, how(r.value).over(frame))

    def _long(self, rolls: Sequence[Roll], ratios: Mapping[str, tuple[str, str]]) -> None:
        added = [*dict.fromkeys([*ratios, *(r.out for r in rolls)])]
        schema = T.StructType([*self.df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in added]])
        self.df = self.df.groupBy("symbol", _CHUNK).applyInArrow(_rolled(rolls, ratios, added, self.rows), schema)

    def core(self) -> DataFrame:
        """The bars themselves, every halo copy dropped."""
        own = F.floor(F.col("pos") / self.rows) == F.col(_CHUNK)
        return self.df.filter(own).drop(_CHUNK)


def halo_frame(bars: DataFrame, lookback: int, chunk_rows: int | None = None) -> HaloFrame:
    """Chunks of at least twice the lookback, so a bar is held at most one and a half times on average."""
    return HaloFrame(bars, lookback, chunk_rows or max(CHUNK_ROWS, 2 * lookback))


def _rolled(rolls: Sequence[Roll], ratios: Mapping[str, tuple[str, str]], added: Sequence[str], rows: int) -> Callable:
    """A function that adds the columns of long windows to one chunk and drops its halo."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        known: dict[str, np.ndarray] = {}

        def column(name: str) -> np.ndarray:
            if name not in known:
                if name in ratios:
                    above, below = map(column, ratios[name])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        known[name] = np.where(below == 0, np.nan, above / below)
                else:
                    known[name] = table[name].cast(pa.float64()).to_numpy()
            return known[name]

        waiting = list(rolls)
        while waiting:
            # those whose input is there, then those that read their results
            open_outs = {r.out for r in waiting}
            now = [r for r in waiting if not open_outs & {r.value, *ratios.get(r.value, ())}]
            for value in dict.fromkeys(r.value for r in now):
                known.update(windows(column(value), [r for r in now if r.value == value]))
            waiting = [r for r in waiting if r not in now]
        own = np.flatnonzero(table["pos"].to_numpy() // rows == table[_CHUNK].to_numpy())
        kept = table.slice(own[0], len(own)) if len(own) else table.slice(0, 0)
        for name in added:
            out = column(name)[own]
            kept = kept.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))
        return kept

    return run


def _back(x: np.ndarray, n: int) -> np.ndarray:
    """The column as it was ``n`` rows before, missing at the start."""
    if n == 0:
        return x
    out = np.full(len(x), np.nan)
    out[n:] = x[: max(len(x) - n, 0)]
    return out


def windows(x: np.ndarray, rolls: Sequence[Roll]) -> dict[str, np.ndarray]:
    """The rolls of one column, missing (NaN) while any of their rows is."""
    out: dict[str, np.ndarray] = {}
    levels = max(r.period for r in rolls).bit_length()
    kinds = {"max": np.maximum, "min": np.minimum}
    for kind, merge in kinds.items():
        asked = [r for r in rolls if r.how == kind]
        wide = x
        for level in range(max((r.period for r in asked), default=0).bit_length()):
            wide = merge(wide, _back(wide, 1 << (level - 1))) if level else x
            for r in asked:
                if r.period.bit_length() - 1 == level:
                    out[r.out] = merge(_back(wide, r.shift), _back(wide, r.shift + r.period - (1 << level)))
    sums = [r for r in rolls if r.how in ("sum", "avg")]
    spreads = [r for r in rolls if r.how == "std"]
    total, mean, m2 = x, x, np.where(np.isnan(x), np.nan, 0.0)
    state: dict[str, tuple] = {}
    for level in range(levels if sums or spreads else 0):
        if level:
            half = 1 << (level - 1)
            if sums:
                total = total + _back(total, half)
            if spreads:
                before = _back(mean, half)
                apart = mean - before
                m2 = m2 + _back(m2, half) + apart * apart * (half / 2)
                mean = (mean + before) / 2
        for r in sums:
            if r.period >> level & 1:
                piece = _back(total, r.shift + (r.period & ((1 << level) - 1)))
                out[r.out] = out[r.out] + piece if r.out in out else piece
        for r in spreads:
            if r.period >> level & 1:
                behind = r.period & ((1 << level) - 1)
                new = (float(1 << level), _back(mean, r.shift + behind), _back(m2, r.shift + behind))
                state[r.out] = _joined(state[r.out], new) if r.out in state else new
    for r in sums:
        if r.how == "avg":
            out[r.out] = out[r.out] / r.period
    return out | {r.out: np.sqrt(state[r.out][2] / r.period) for r in spreads}


def _joined(a: tuple, b: tuple) -> tuple:
    """(rows, mean, squared distance) of two neighbouring windows as one; exact where both means are equal."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)
