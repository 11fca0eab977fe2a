"""Backtests and parameter sweeps: one Spark plan for every symbol and parameter set."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.functions.signals import breakout_event
from sparkbars.functions.sizing import ScalarSizer
from sparkbars.operators.equity import display_metrics, run_metrics
from sparkbars.operators.indicators import add_channels
from sparkbars.operators.labels import label_triple_barrier
from sparkbars.operators.trades import Run, run_signals, select_trades, trade_candidates
from sparkbars.session import cut

RUN_FIELDS = [f.name for f in fields(Run) if f.name != "run_id"]
_INT_FIELDS = ("entry_period", "exit_period", "atr_period")
BARRIER_FIELDS = ("horizon", "tp", "sl")
# Smallest usable value of a parameter, and whether it must lie above it.
_LEAST = {
    **dict.fromkeys([*_INT_FIELDS, "horizon"], (1, "at least")),
    **dict.fromkeys(["atr_mult", "tp", "cash", "risk_pct", "max_leverage"], (0, "above")),
    **dict.fromkeys(["intensity_threshold", "commission"], (0, "at least")),
}

# (bars, combinations that can run, by number) -> rows with run_id
SweepTarget = Callable[[DataFrame, Mapping[int, Mapping[str, object]]], DataFrame]


def grid_values(value: object) -> list:
    """The values of one grid entry: text and scalars are one value, anything else that can be iterated is a list."""
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable) or getattr(value, "ndim", 1) == 0:
        return [value]
    return [v.item() if hasattr(v, "item") else v for v in value]


def expand_grid(grid: Mapping[str, object]) -> list[dict]:
    """Every combination of a grid, a scalar counting as one value; an empty grid gives one empty set."""
    values = [grid_values(v) for v in grid.values()]
    return [dict(zip(grid, combo, strict=True)) for combo in itertools.product(*values)]


def grid_rows(spark, grid: Mapping[str, object]) -> DataFrame:
    """The expanded grid as a table with ``run_id``, made by exploding one array per parameter."""
    rows = spark.range(1).select(F.lit(0).cast("long").alias("run_id"))
    for name, v in grid.items():
        values = grid_values(v)
        rows = rows.select(
            "*", F.posexplode(F.array(*[F.lit(x) for x in values])).alias("_i", name)
        ).withColumn("run_id", F.col("run_id") * len(values) + F.col("_i")).drop("_i")
    return rows


def coupled(params: Mapping[str, object]) -> dict:
    """Lookbacks tied to the entry channel: half of it for exits, all of it for the range."""
    entry = int(params["entry_period"])
    return {**params, "exit_period": entry // 2, "atr_period": entry}


def combo_error(combo: Mapping[str, object]) -> str | None:
    """Why a combination cannot run."""
    for name, value in combo.items():
        if value is None or isinstance(value, (str, bytes)) or value != value:
            return f"{name} must be a number"
        low, text = _LEAST.get(name, (None, ""))
        if low is not None and (value <= low if text == "above" else value < low):
            return f"{name} must be {text} {low:g}"
    if combo.get("sl", -1) >= 0:
        return "sl must be below 0"
    return None


def runs_of(combos: Sequence[Mapping[str, object]], more: Sequence[str] = ()) -> tuple[list[Run], dict[int, str]]:
    """Runs of the usable combinations, and the error text of the others, by place in the list.

    A name that is neither a field of a run nor in ``more`` is an error of the whole grid.
    """
    unknown = sorted({k for c in combos for k in c} - {*RUN_FIELDS, *more})
    if unknown:
        raise ValueError(f"unknown parameters {unknown}; known: {', '.join([*RUN_FIELDS, *more])}")
    runs, errors = [], {}
    for i, combo in enumerate(combos):
        params = {k: v for k, v in combo.items() if k in RUN_FIELDS}
        if error := combo_error(combo):
            errors[i] = error
        else:
            runs.append(Run(i, **{k: int(v) if k in _INT_FIELDS else float(v) for k, v in params.items()}))
    return runs, errors


@dataclass(frozen=True)
class Backtest:
    """Tables of one backtest job, each keyed by run_id and symbol."""

    bars: DataFrame
    candidates: DataFrame
    trades: DataFrame
    metrics: DataFrame


def channel_table(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Bars with the channels of every distinct period of the runs, written once."""
    columns = bars.select("symbol", "pos", "open_time", "high", "low", "close")
    return cut(
        add_channels(
            columns, [r.entry_period for r in runs], [r.exit_period for r in runs], [r.atr_period for r in runs]
        )
    )


def backtest(
    bars: DataFrame,
    runs: Sequence[Run],
    initial_capital: float = 10_000.0,
    commission: float = 0.0005,
    sizer: ScalarSizer | None = None,
    fill_model: str = "worse_of",
    periods_per_year: float = 525_600,
    keep_entry: Callable[[DataFrame], DataFrame] | None = None,
    only: DataFrame | None = None,
) -> Backtest:
    """Trades and raw metrics of every run on every symbol.

    ``only`` may name the (run_id, symbol) pairs to trade; the others show no trades.
    ``keep_entry`` may filter the candidates before trades are chosen, for instance by a
    model score; it sees no capital, so it cannot depend on earlier trades.
    """
    prepared = channel_table(bars, runs)
    signals = run_signals(prepared, runs)
    if only is not None:
        signals = signals.join(only, ["run_id", "symbol"], "left_semi")
    candidates = trade_candidates(signals, prepared, fill_model)
    if keep_entry is not None:
        candidates = keep_entry(candidates)
    trades = cut(select_trades(candidates, initial_capital, commission, sizer, runs))
    metrics = run_metrics(trades, prepared, runs, initial_capital, commission, periods_per_year)
    return Backtest(prepared, candidates, trades, metrics)


def _kind(name: str, values: Sequence[object]) -> str:
    """Type of a parameter column: text and flags of a swept target stay what they are."""
    if name in _INT_FIELDS or name == "horizon":
        return "int"
    known = [v for v in values if v is not None]
    if name in RUN_FIELDS or name in BARRIER_FIELDS:
        return "double"
    if known and all(isinstance(v, bool) for v in known):
        return "boolean"
    return "double" if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known) else "string"


def _with_params(result: DataFrame, combos: Sequence[Mapping], errors: Mapping[int, str]) -> DataFrame:
    """Parameter columns by run; a combination that could not run has one row with its error text."""
    spark = result.sparkSession
    names = list(dict.fromkeys(k for c in combos for k in c))
    kinds = {n: _kind(n, [c.get(n) for c in combos]) for n in names}
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("run_id"),
            F.lit(errors.get(i)).cast("string").alias("error"),
            *[F.lit(c.get(n)).try_cast(k).alias(n) for n, k in kinds.items()],
        )
        for i, c in enumerate(combos)
    ])
    params = spark.range(1).select(F.explode(rows).alias("p")).select("p.*")
    return params.join(result, "run_id", "left").select(
        "run_id", *names, *[c for c in result.columns if c != "run_id"], "error"
    )


def ranked(result: DataFrame, rank_by: str, ascending: bool = False) -> DataFrame:
    """Best rows first; equal values by symbol and run."""
    order = F.col(rank_by).asc_nulls_last() if ascending else F.col(rank_by).desc_nulls_last()
    return result.orderBy(order, "symbol", "run_id")


def without_errors(result: DataFrame) -> DataFrame:
    return result.filter(F.col("error").isNull())


def finite_profit_factor(metrics: DataFrame, cap: float = 999.0) -> DataFrame:
    """An infinite profit factor shown as one fixed large number."""
    pf = F.col("profit_factor")
    return metrics.withColumn("profit_factor", F.when(pf == float("inf"), F.lit(cap)).otherwise(pf))


def sweep_backtest(
    bars: DataFrame,
    grid: Mapping[str, object],
    rank_by: str = "sharpe",
    ascending: bool = False,
    couple: bool = False,
    **options,
) -> DataFrame:
    """Rounded metrics of every combination and symbol, best first.

    With ``couple`` the exit and range periods follow the entry period and a ``score``
    takes two hundredths of the drawdown off the Sharpe ratio.
    """
    combos = expand_grid(grid)
    runs, errors = runs_of([coupled(c) for c in combos] if couple else combos)
    if not runs:  # nothing can run: the rows of a run over no bars are none, and the errors remain
        bars, runs = bars.limit(0), [Run(-1)]
    result = finite_profit_factor(display_metrics(backtest(bars, runs, **options).metrics))
    if couple:
        result = result.withColumn("score", F.col("sharpe") - F.col("max_dd_pct") * 0.02)
    return ranked(_with_params(result, combos, errors), rank_by, ascending)


def _isolated(spark: SparkSession, make: Callable[[], DataFrame], timeout: float | None) -> tuple[DataFrame | None, str | None]:
    """The written rows of a job that runs apart from others, or what became of it.

    The job has a group of its own. After ``timeout`` seconds the group is cancelled and its tasks are interrupted; a
    function that hangs on the driver cannot be stopped and is left to itself.
    """
    group, done = f"sweep-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "one part of a sweep", interruptOnCancel=True)
        try:
            done["rows"] = cut(make())
        except Exception as e:  # a target may fail in any way; its words become the row's error
            done["error"] = (str(e) or type(e).__name__).split("\n")[0]

    job = InheritableThread(target=run, session=spark, daemon=True)
    job.start()
    job.join(timeout)
    if job.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        return None, "timeout"
    return done.get("rows"), done.get("error")


def sweep(
    bars: DataFrame, grid: Mapping[str, object], target: SweepTarget, timeout: float | None = None, n_jobs: int = 4
) -> DataFrame:
    """Rows of any target for every combination; one that fails shows its error text, one that hangs ``timeout``.

    ``target`` gets the combinations by number and returns rows with ``run_id``. All of them together are one
    job, with ``timeout`` seconds per combination. If that job fails, while its plan is built or while it runs, each combination is
    a job of its own, ``n_jobs`` at a time, so that one bad set cannot hide the rest.
    """
    spark = bars.sparkSession
    combos = dict(enumerate(expand_grid(grid)))
    errors: dict[int, str] = {}
    result, failed = _isolated(spark, lambda: target(bars, combos), timeout and timeout * len(combos))
    if failed:
        with ThreadPoolExecutor(n_jobs) as pool:
            alone = pool.map(lambda item: _isolated(spark, lambda: target(bars, dict([item])), timeout), combos.items())
            parts = dict(zip(combos, alone, strict=True))
        for i in [i for i, (_, error) in parts.items() if error == "timeout" and n_jobs > 1]:
            # it may have waited for one that hangs, so its time counts again, alone
            parts[i] = _isolated(spark, lambda: target(bars, {i: combos[i]}), timeout)
        errors = {i: error for i, (_, error) in parts.items() if error}
        good = [rows for rows, _ in parts.values() if rows is not None]
        result = reduce(DataFrame.unionByName, good) if good else spark.createDataFrame([], "run_id int")
    return _with_params(result, list(combos.values()), errors)


def run_events(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Signed breakout events of every run, one row per (run_id, symbol, pos)."""
    sides = [
        F.struct(
            F.lit(r.run_id).alias("run_id"),
            breakout_event(
                r.intensity_threshold, entry_high=f"high_{r.entry_period}", entry_low=f"low_{r.entry_period}",
                atr=f"atr_{r.atr_period}",
            ).alias("side"),
        )
        for r in runs
    ]
    hits = F.filter(F.array(*sides), lambda s: s["side"] != 0)
    return bars.select("symbol", "pos", "close", F.explode(hits).alias("s")).select(
        F.col("s.run_id").alias("run_id"), "symbol", "pos", F.col("s.side").alias("side"), "close"
    )


def sweep_dataset(bars: DataFrame, grid: Mapping[str, object]) -> DataFrame:
    """Event counts and label rates of every combination, over all symbols of ``bars``.

    Grid names are those of a run plus ``horizon``, ``tp`` and ``sl``. Combinations share
    labels: an event is labelled once per distinct barrier setting.
    """
    combos = [{"horizon": 288, "tp": 0.02, "sl": -0.01, **c} for c in expand_grid(grid)]
    runs, errors = runs_of(combos, BARRIER_FIELDS)
    if not runs:
        bars, runs = bars.limit(0), [Run(-1)]
    prepared = channel_table(bars, runs)
    settings = F.array(*[
        F.struct(
            F.lit(i).alias("run_id"), F.lit(c["horizon"]).try_cast("int").alias("horizon"),
            F.lit(c["tp"]).try_cast("double").alias("tp"), F.lit(c["sl"]).try_cast("double").alias("sl"),
        )
        for i, c in enumerate(combos)
    ])
    events = run_events(prepared, runs)
    setting = F.element_at(settings, F.col("run_id") + 1)
    events = events.withColumns({k: setting[k] for k in ("horizon", "tp", "sl")})
    what = ["symbol", "pos", "side", "horizon", "tp", "sl"]
    distinct = events.groupBy(*what).agg(F.first("close").alias("close"))
    labels = label_triple_barrier(
        prepared, distinct, "tp", "sl", "horizon", keys=("side", "horizon", "tp", "sl")
    )
    rate = lambda v: F.avg(F.when(F.col("label") == v, 1.0).otherwise(0.0))
    result = events.drop("close").join(labels, what).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        rate(1).alias("label_1_rate"),
        rate(-1).alias("label_neg1_rate"),
        rate(0).alias("label_0_rate"),
        F.avg("actual_return").alias("mean_return"),
        F.avg("n_bars_held").alias("mean_bars_held"),
    )
    full = _with_params(result, combos, errors)
    return full.fillna(0, ["n_events"]).orderBy(F.col("n_events").desc(), "run_id")


def train_test_topk(
    train: DataFrame,
    test: DataFrame,
    grid: Mapping[str, object],
    k: int = 5,
    rank_by: str = "score",
    **options,
) -> DataFrame:
    """The ``k`` best combinations per symbol on ``train``, measured again on ``test``; best test Sharpe first.

    The chosen pairs go from one sweep to the next as a table, not through the driver.
    """
    best_first = [F.col(rank_by).desc_nulls_last(), F.col("run_id")]
    trained = without_errors(sweep_backtest(train, grid, rank_by, couple=True, **options))
    top = trained.withColumn("_rank", F.row_number().over(W.partitionBy("symbol").orderBy(*best_first))).filter(
        F.col("_rank") <= k
    )
    params = [n for n in grid]
    top = cut(top.select("run_id", "symbol", *params, F.col("sharpe").alias("train_sharpe")))
    runs, _ = runs_of([coupled(c) for c in expand_grid(grid)])
    tested = display_metrics(backtest(test, runs, only=top, **options).metrics).select(
        "run_id", "symbol", F.col("sharpe").alias("test_sharpe"), F.col("max_dd_pct").alias("test_max_dd_pct"),
        F.col("total_return_pct").alias("test_return_pct"),
    )
    return top.join(tested, ["run_id", "symbol"]).orderBy(F.col("test_sharpe").desc(), "symbol", "run_id")
