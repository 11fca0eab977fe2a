"""Backtests, sweeps, sizing, admission and ledgers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkbars.catalog.inputs import BARS_PER_YEAR, event_bars, event_bars_sql, table
from sparkbars.catalog.registry import ctes, r6, register, rounded
from sparkbars.functions import orders as O
from sparkbars.functions import sizing as Z
from sparkbars.functions.signals import stop_level
from sparkbars.operators.equity import drawdown, equity_curve
from sparkbars.operators.ledger import fill_ledger
from sparkbars.operators.running import Running, running
from sparkbars.operators.trades import Run, run_signals, select_trades, trade_candidates, trade_log
from sparkbars.plans import sweep as P
from sparkbars.session import cut

ONE_RUN = [Run(0, 20, 10, 20, 2.0, 0.0)]
GRID = {"entry_period": [20, 40], "exit_period": 10, "atr_period": 20, "atr_mult": [2.0, 3.0],
        "intensity_threshold": [0.0, 0.5]}
COUPLED_GRID = {"entry_period": [20, 40], "atr_mult": [2.0, 4.0], "intensity_threshold": [0.0, 0.5]}
COST = 0.00005
OPTIONS = dict(commission=COST, periods_per_year=BARS_PER_YEAR)


# ---- SQL twins ---------------------------------------------------------------------------------

def _window(kind: str, column: str, rows: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({column}) {over} = {rows} THEN {kind}({column}) {over} END"


def runs_sql(runs, bars: str = "bars", fill: str = "worse_of") -> str:
    """Signals and candidate exits of the runs, by range joins on ``bars``."""
    channels = sorted({r.entry_period for r in runs} | {r.exit_period for r in runs})
    atrs = sorted({r.atr_period for r in runs})
    cols = [f"{_window('max', 'high', p)} AS high_{p}, {_window('min', 'low', p)} AS low_{p}" for p in channels]
    cols += [f"{_window('avg', 'tr', p)} AS atr_{p}" for p in atrs]
    per_run = " UNION ALL ".join(
        f"""SELECT {r.run_id} AS run_id, symbol, pos, open_time, high, low, close, atr_{r.atr_period} AS atr,
        {r.warmup} AS warmup, CAST({r.atr_mult} AS DOUBLE) AS mult, CAST({r.intensity_threshold} AS DOUBLE) AS threshold,
        high_{r.entry_period} AS eh, low_{r.entry_period} AS el, high_{r.exit_period} AS xh, low_{r.exit_period} AS xl,
        CASE WHEN atr_{r.atr_period} > 0 THEN atr_{r.atr_period} ELSE 1.0 END AS unit FROM chan"""
        for r in runs
    )
    price = "CASE WHEN c.side = 1 THEN least(x.close, c.stop) ELSE greatest(x.close, c.stop) END"
    if fill == "stop_price":
        price = "c.stop"
    touched = "((c.side = 1 AND x.low <= c.stop) OR (c.side = -1 AND x.high >= c.stop))"
    return f"""
chan0 AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr
  FROM {bars} WINDOW s AS (PARTITION BY symbol ORDER BY pos)),
chan AS (SELECT *, {", ".join(cols)} FROM chan0),
perrun AS ({per_run}),
sig AS (
  SELECT *, CASE WHEN close < el AND (el - close) / unit > threshold THEN -1
                 WHEN close > eh AND (close - eh) / unit > threshold THEN 1
                 WHEN close > xh THEN -2 WHEN close < xl THEN 2 ELSE 0 END AS signal
  FROM perrun WHERE pos >= warmup),
ent AS (
  SELECT run_id, symbol, pos, signal AS side, close AS entry_price,
         CASE WHEN signal = 1 THEN close - atr * mult ELSE close + atr * mult END AS stop, atr, mult
  FROM sig WHERE abs(signal) = 1),
exits AS (
  SELECT c.run_id, c.symbol, c.pos, min(x.pos) AS exit_pos FROM ent c JOIN sig x
    ON x.run_id = c.run_id AND x.symbol = c.symbol AND x.pos > c.pos AND ({touched} OR x.signal = 2 * c.side)
  GROUP BY c.run_id, c.symbol, c.pos),
cand AS (
  SELECT c.*, e.exit_pos, CASE WHEN e.exit_pos IS NULL THEN NULL WHEN {touched} THEN 'stop' ELSE 'signal' END AS exit_reason,
         CASE WHEN e.exit_pos IS NULL THEN NULL WHEN {touched} THEN {price} ELSE x.close END AS exit_price,
         row_number() OVER (PARTITION BY c.run_id, c.symbol ORDER BY c.pos) AS idx
  FROM ent c LEFT JOIN exits e ON e.run_id = c.run_id AND e.symbol = c.symbol AND e.pos = c.pos
  LEFT JOIN sig x ON x.run_id = c.run_id AND x.symbol = c.symbol AND x.pos = e.exit_pos)
"""


def fold_sql(cost: float, size: str = "floor(least({cap} * 0.02 / abs(entry_price - stop), {cap} * 20 / entry_price) * 1000) / 1000") -> str:
    """One position at a time with compounding capital, as a recursive query."""
    sized = size.format(cap="f.capital")
    guarded = f"CASE WHEN abs(entry_price - stop) > 0 AND f.capital > 0 THEN {sized} ELSE 0 END"
    return f"""
jump AS (
  SELECT c.run_id, c.symbol, c.idx, min(n.idx) AS next_idx FROM cand c LEFT JOIN cand n
    ON n.run_id = c.run_id AND n.symbol = c.symbol AND n.pos > c.exit_pos GROUP BY c.run_id, c.symbol, c.idx),
steps AS (SELECT c.*, j.next_idx FROM cand c JOIN jump j ON c.run_id = j.run_id AND c.symbol = j.symbol AND c.idx = j.idx),
fold AS (
  SELECT run_id, symbol, CAST(1 AS BIGINT) AS idx, CAST(10000 AS DOUBLE) AS capital, CAST(0 AS BIGINT) AS skipped
  FROM (SELECT DISTINCT run_id, symbol FROM cand)
  UNION ALL
  SELECT f.run_id, f.symbol, CASE WHEN {guarded} <= 0 THEN c.idx + 1 ELSE c.next_idx END,
    f.capital + CASE WHEN {guarded} <= 0 THEN 0 ELSE
      c.side * (c.exit_price - c.entry_price) * ({guarded}) - {cost} * (c.entry_price + c.exit_price) * ({guarded}) END,
    f.skipped + CASE WHEN {guarded} <= 0 THEN 1 ELSE 0 END
  FROM fold f JOIN steps c ON c.run_id = f.run_id AND c.symbol = f.symbol AND c.idx = f.idx
  WHERE {guarded} <= 0 OR c.exit_pos IS NOT NULL),
tried AS (
  SELECT c.*, f.capital AS capital_before, f.skipped AS skipped_before, {guarded} AS size
  FROM fold f JOIN steps c ON c.run_id = f.run_id AND c.symbol = f.symbol AND c.idx = f.idx),
trades AS (
  SELECT *, CASE WHEN size <= 0 THEN 'skipped' WHEN exit_pos IS NULL THEN 'open' ELSE 'closed' END AS status,
    CASE WHEN size > 0 THEN side * (exit_price - entry_price) * size - {cost} * (entry_price + exit_price) * size END AS pnl
  FROM tried)
"""


CURVE_SQL = """
marked AS (
  SELECT s.run_id, s.symbol, s.pos, s.close, s.warmup, t.*  EXCLUDE (run_id, symbol, pos), t.pos AS entry_pos
  FROM sig s ASOF LEFT JOIN (SELECT * FROM trades WHERE status <> 'skipped') t
    ON t.run_id = s.run_id AND t.symbol = s.symbol AND s.pos >= t.pos),
curve AS (
  SELECT m.run_id, m.symbol, m.pos, m.warmup,
    CASE WHEN entry_pos IS NULL THEN 10000.0 WHEN exit_pos IS NOT NULL AND m.pos >= exit_pos THEN capital_before + pnl
         ELSE capital_before + side * (m.close - entry_price) * size END AS equity,
    z.pos IS NOT NULL AS skipped
  FROM marked m LEFT JOIN (SELECT run_id, symbol, pos FROM trades WHERE status = 'skipped') z
    ON z.run_id = m.run_id AND z.symbol = m.symbol AND z.pos = m.pos)
"""

_TRADE_STATS = """
  count(*) FILTER (status = 'closed') AS n_trades,
  count(*) FILTER (status = 'closed' AND pnl > 0) AS n_wins, count(*) FILTER (status = 'closed' AND pnl < 0) AS n_losses,
  coalesce(sum(pnl) FILTER (status = 'closed' AND pnl > 0), 0) AS won,
  coalesce(sum(pnl) FILTER (status = 'closed' AND pnl < 0), 0) AS lost,
  coalesce(avg(pnl) FILTER (status = 'closed'), 0) AS avg_trade_pnl,
  coalesce(avg(exit_pos - pos) FILTER (status = 'closed'), 0) AS avg_bars_held,
  arg_max(capital_before + CASE WHEN status = 'closed' THEN pnl ELSE 0 END, pos) AS final_capital
"""


def metrics_sql(cost: float, per_year: int) -> str:
    return f"""
pts AS (
  SELECT run_id, symbol, warmup, pos, equity FROM curve WHERE NOT skipped
  UNION ALL SELECT DISTINCT run_id, symbol, warmup, -1, CAST(10000 AS DOUBLE) FROM sig),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS k, equity / lag(equity) OVER w - 1 AS ret,
         (equity - max(equity) OVER (w ROWS UNBOUNDED PRECEDING)) / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) * 100 AS dd
  FROM pts WINDOW w AS (PARTITION BY run_id, symbol ORDER BY pos)),
curve_stats AS (
  SELECT run_id, symbol, avg(ret) FILTER (k > warmup) AS mean_ret, stddev_samp(ret) FILTER (k > warmup) AS std_ret,
         abs(min(dd)) AS max_dd_pct, (arg_max(equity, k) / 10000 - 1) * 100 AS total_return_pct
  FROM numbered GROUP BY run_id, symbol),
trade_stats AS (SELECT run_id, symbol, {_TRADE_STATS},
    coalesce(sum({cost} * (entry_price + exit_price) * size) FILTER (status = 'closed'), 0) AS total_fees
  FROM trades GROUP BY run_id, symbol),
metrics AS (
  SELECT c.run_id, c.symbol,
    CASE WHEN std_ret > 0 THEN mean_ret / std_ret * sqrt({per_year}) ELSE 0 END AS sharpe,
    coalesce(n_wins / nullif(n_trades, 0), 0) AS win_rate, total_return_pct, max_dd_pct,
    coalesce(n_trades, 0) AS n_trades, coalesce(n_wins, 0) AS n_wins, coalesce(n_losses, 0) AS n_losses,
    CASE WHEN coalesce(n_trades, 0) = 0 THEN 0 WHEN lost < 0 THEN won / abs(lost) ELSE 999 END AS profit_factor,
    coalesce(avg_trade_pnl, 0) AS avg_trade_pnl, coalesce(won / nullif(n_wins, 0), 0) AS avg_win,
    coalesce(lost / nullif(n_losses, 0), 0) AS avg_loss, coalesce(avg_bars_held, 0) AS avg_bars_held,
    coalesce(total_fees, 0) AS total_fees, coalesce(final_capital, 10000) AS final_capital
  FROM curve_stats c LEFT JOIN trade_stats t ON t.run_id = c.run_id AND t.symbol = c.symbol)
"""


def backtest_sql(runs, select: str, *extra: str, cost: float = COST, fill: str = "worse_of") -> str:
    return ctes(event_bars_sql(), runs_sql(runs, fill=fill), fold_sql(cost), *extra, recursive=True) + select


# ---- candidates, trades, curves ------------------------------------------------------------------


def _candidates(spark, sf, runs, **kw):
    prepared = P.channel_table(event_bars(spark, sf), runs)
    return prepared, trade_candidates(run_signals(prepared, runs), prepared, **kw)


_RUNS, _ = P.runs_of(P.expand_grid(GRID))


@register(
    "trade_candidates",
    ctes(event_bars_sql(), runs_sql(ONE_RUN))
    + f"SELECT symbol, pos, side, exit_pos, exit_reason, {r6('entry_price stop exit_price')} FROM cand",
)
def candidates(spark, sf):
    rows = _candidates(spark, sf, ONE_RUN)[1]
    return rounded(rows.select(
        "symbol", "pos", "side", "exit_pos", "exit_reason", "entry_price", F.col("stop_price").alias("stop"), "exit_price"
    ))


@register(
    "trade_candidates_stop_fill",
    ctes(event_bars_sql(), runs_sql(ONE_RUN, fill="stop_price"))
    + f"SELECT symbol, pos, side, exit_pos, exit_reason, {r6('exit_price')} FROM cand",
)
def candidates_stop_fill(spark, sf):
    rows = _candidates(spark, sf, ONE_RUN, fill_model="stop_price")[1]
    return rounded(rows.select("symbol", "pos", "side", "exit_pos", "exit_reason", "exit_price"))


_TRADE_COLUMNS = "entry_price exit_price stop_price size pnl pnl_pct"


@register(
    "trades",
    backtest_sql(
        ONE_RUN,
        f"""SELECT t.symbol, a.open_time AS entry_time, b.open_time AS exit_time,
        CASE WHEN t.side = 1 THEN 'long' ELSE 'short' END AS side, t.exit_pos - t.pos AS bars_held, t.exit_reason,
        {r6('entry_price exit_price size pnl', 't')}, round(t.stop, 6) AS stop_price, round(t.pnl / 100, 6) + 0.0 AS pnl_pct
        FROM trades t JOIN bars a ON a.symbol = t.symbol AND a.pos = t.pos
        JOIN bars b ON b.symbol = t.symbol AND b.pos = t.exit_pos WHERE t.status = 'closed'""",
    ),
)
def trades(spark, sf):
    prepared, cand = _candidates(spark, sf, ONE_RUN)
    return rounded(trade_log(select_trades(cand, commission=COST), prepared).drop("run_id"))


def _curve(spark, sf) -> DataFrame:
    prepared, cand = _candidates(spark, sf, ONE_RUN)
    done = cut(select_trades(cand, commission=COST))
    return equity_curve(done, prepared, ONE_RUN)


@register("equity_curve", backtest_sql(ONE_RUN, f"SELECT symbol, pos, skipped, {r6('equity')} FROM curve", CURVE_SQL))
def curve(spark, sf):
    return rounded(_curve(spark, sf).drop("run_id"))


@register(
    "drawdown",
    backtest_sql(
        ONE_RUN,
        """SELECT symbol, pos, round(equity, 6) AS equity, round(peak, 6) AS peak,
        round((equity - peak) * 100 / peak, 6) + 0.0 AS drawdown_pct
        FROM (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS peak
              FROM curve)""",
        CURVE_SQL,
    ),
)
def drawdowns(spark, sf):
    return rounded(drawdown(cut(_curve(spark, sf))).drop("run_id"))


_METRIC_DOUBLES = (
    "sharpe win_rate total_return_pct max_dd_pct profit_factor avg_trade_pnl avg_win avg_loss avg_bars_held "
    "total_fees final_capital"
)


@register(
    "run_metrics",
    backtest_sql(
        ONE_RUN, f"SELECT symbol, n_trades, n_wins, n_losses, {r6(_METRIC_DOUBLES)} FROM metrics",
        CURVE_SQL, metrics_sql(COST, BARS_PER_YEAR),
    ),
)
def metrics(spark, sf):
    done = P.backtest(event_bars(spark, sf), ONE_RUN, **OPTIONS)
    return rounded(P.finite_profit_factor(done.metrics).drop("run_id"))


# ---- sweeps --------------------------------------------------------------------------------------


@register(
    "param_grid",
    """SELECT CAST(row_number() OVER (ORDER BY e, m, t) - 1 AS BIGINT) AS run_id, e AS entry_period, m AS atr_mult,
      t AS intensity_threshold, n_bars FROM (SELECT unnest([10, 20, 40, 80]) AS e),
      (SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE]) AS m), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS t),
      (SELECT count(*) AS n_bars FROM events)""",
)
def param_grid(spark, sf):
    grid = {"entry_period": [10, 20, 40, 80], "atr_mult": [2.0, 3.0, 4.0], "intensity_threshold": [0.0, 0.5, 1.0]}
    ticks = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n")).scalar()
    return P.grid_rows(spark, grid).withColumn("n_bars", ticks)


def _run_values(runs, names) -> str:
    rows = ", ".join(f"({r.run_id}, " + ", ".join(str(getattr(r, n)) for n in names) + ")" for r in runs)
    return f"params(run_id, {', '.join(names)}) AS (VALUES {rows})"


_SHOWN = """
shown AS (
  SELECT run_id, symbol, round(sharpe, 4) + 0.0 AS sharpe, round(win_rate, 4) AS win_rate,
    round(total_return_pct, 2) + 0.0 AS total_return_pct, round(max_dd_pct, 2) AS max_dd_pct, n_trades,
    round(profit_factor, 2) AS profit_factor, round(avg_trade_pnl, 2) + 0.0 AS avg_trade_pnl FROM metrics)
"""
_PARAMS = ("entry_period", "exit_period", "atr_period", "atr_mult", "intensity_threshold")


@register(
    "sweep_backtest",
    backtest_sql(
        _RUNS,
        """SELECT s.*, p.entry_period, p.exit_period, p.atr_period, CAST(p.atr_mult AS DOUBLE) AS atr_mult,
        CAST(p.intensity_threshold AS DOUBLE) AS intensity_threshold FROM shown s JOIN params p ON p.run_id = s.run_id""",
        CURVE_SQL, metrics_sql(COST, BARS_PER_YEAR), _SHOWN, _run_values(_RUNS, _PARAMS),
    ),
)
def sweep_backtest(spark, sf):
    out = P.sweep_backtest(event_bars(spark, sf), GRID, **OPTIONS)
    return out.select(
        "run_id", "symbol", *_PARAMS, "sharpe", "win_rate", "total_return_pct", "max_dd_pct", "n_trades",
        "profit_factor", "avg_trade_pnl",
    )


_COUPLED, _ = P.runs_of([P.coupled(c) for c in P.expand_grid(COUPLED_GRID)])


@register(
    "sweep_coupled_score",
    backtest_sql(
        _COUPLED,
        """SELECT run_id, symbol, sharpe, max_dd_pct, round(sharpe - 0.02::DOUBLE * max_dd_pct, 6) + 0.0 AS score,
        total_return_pct, n_trades, rank_no FROM (SELECT *, row_number() OVER (ORDER BY sharpe - 0.02::DOUBLE * max_dd_pct DESC,
        symbol, run_id) AS rank_no FROM shown)""",
        CURVE_SQL, metrics_sql(COST, BARS_PER_YEAR), _SHOWN,
    ),
)
def sweep_coupled(spark, sf):
    out = P.sweep_backtest(event_bars(spark, sf), COUPLED_GRID, rank_by="score", couple=True, **OPTIONS)
    shown = out.select("run_id", "symbol", "sharpe", "max_dd_pct", "score", "total_return_pct", "n_trades")
    # One row per run and symbol: numbering them needs no distribution.
    order = W.orderBy(F.col("score").desc(), "symbol", "run_id")
    return shown.withColumn("rank_no", F.row_number().over(order).cast("long")).withColumn("score", F.round("score", 6))


ACCOUNT_GRID = {"entry_period": [20, 40], "exit_period": 10, "atr_period": 20, "atr_mult": 2.0, "risk_pct": [0.004, 0.05],
                "cash": [2000.0, 50000.0], "max_leverage": [2.0], "commission": 0.0001}
_ACCOUNT_PERIODS = [Run(i, 20 if i < 4 else 40, 10, 20, 2.0, 0.0) for i in range(8)]
_ACCOUNTS = """
acct(run_id, cash, risk) AS (VALUES (0, 2000.0, 0.004), (1, 50000.0, 0.004), (2, 2000.0, 0.05), (3, 50000.0, 0.05),
  (4, 2000.0, 0.004), (5, 50000.0, 0.004), (6, 2000.0, 0.05), (7, 50000.0, 0.05))"""


def _accounts_sql() -> str:
    size = "floor(least({cap} * f.risk / abs(entry_price - stop), {cap} * 2 / entry_price) * 1000) / 1000"
    fold = fold_sql(0.0001, size)
    fold = fold.replace("CAST(10000 AS DOUBLE) AS capital, CAST(0 AS BIGINT) AS skipped",
                        "CAST(cash AS DOUBLE) AS capital, CAST(0 AS BIGINT) AS skipped, CAST(risk AS DOUBLE) AS risk")
    fold = fold.replace("FROM (SELECT DISTINCT run_id, symbol FROM cand)", "FROM (SELECT DISTINCT run_id, symbol FROM cand) JOIN acct USING (run_id)")
    head, tail = fold.split("THEN 1 ELSE 0 END\n  FROM fold f")
    return ctes(
        event_bars_sql(), runs_sql(_ACCOUNT_PERIODS), _ACCOUNTS, head + "THEN 1 ELSE 0 END, f.risk\n  FROM fold f" + tail,
        f"stats AS (SELECT run_id, symbol, {_TRADE_STATS}, coalesce(sum(0.0001 * (entry_price + exit_price) * size) "
        "FILTER (status = 'closed'), 0) AS fees FROM trades GROUP BY run_id, symbol)",
        recursive=True,
    ) + """SELECT a.run_id, s.symbol, CAST(cash AS DOUBLE) AS cash, CAST(risk AS DOUBLE) AS risk_pct, coalesce(n_trades, 0) AS n_trades,
      round(coalesce(final_capital, cash), 4) AS final_capital, round(coalesce(fees, 0), 2) AS total_fees
    FROM acct a CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN stats t ON t.run_id = a.run_id AND t.symbol = s.symbol"""


@register("sweep_accounts", _accounts_sql())
def sweep_accounts(spark, sf):
    out = P.sweep_backtest(event_bars(spark, sf), ACCOUNT_GRID, periods_per_year=BARS_PER_YEAR)
    return out.select("run_id", "symbol", "cash", "risk_pct", "n_trades", F.round("final_capital", 4).alias("final_capital"), "total_fees")


DATA_GRID = {"entry_period": [20, 40], "atr_period": 20, "intensity_threshold": [0.0, 0.5], "horizon": [36, 72],
             "tp": 0.01, "sl": -0.005}
_DATA_COMBOS = P.expand_grid(DATA_GRID)


def _dataset_sweep_sql(combos=None) -> str:
    combos = dict(enumerate(_DATA_COMBOS)) if combos is None else combos
    runs = [Run(i, c["entry_period"], 10, 20, 2.0, c["intensity_threshold"]) for i, c in combos.items()]
    bars = runs_sql(runs).split("perrun AS")[0].strip().rstrip(",")
    per_run = " UNION ALL ".join(
        f"""SELECT {i} AS run_id, {c['horizon']} AS horizon, symbol, pos, close AS entry_price,
        CASE WHEN close < low_{c['entry_period']} AND (low_{c['entry_period']} - close) / u > {c['intensity_threshold']} THEN -1
             WHEN close > high_{c['entry_period']} AND (close - high_{c['entry_period']}) / u > {c['intensity_threshold']}
             THEN 1 ELSE 0 END AS side
        FROM (SELECT *, CASE WHEN atr_20 > 0 THEN atr_20 ELSE 1.0 END AS u FROM chan)"""
        for i, c in combos.items()
    )
    return ctes(
        event_bars_sql(), bars,
        f"""ev AS (SELECT *, CASE WHEN side = 1 THEN entry_price * 1.01::DOUBLE ELSE entry_price / 1.01::DOUBLE END AS tp,
          CASE WHEN side = 1 THEN entry_price * 0.995::DOUBLE ELSE entry_price / 0.995::DOUBLE END AS sl
          FROM ({per_run}) WHERE side <> 0),
        ends AS (SELECT symbol, max(pos) AS last_pos FROM bars GROUP BY symbol),
        touch AS (SELECT l.run_id, l.symbol, l.pos,
          min(CASE WHEN (l.side = 1 AND b.high >= l.tp) OR (l.side = -1 AND b.low <= l.tp) THEN b.pos END) AS win,
          min(CASE WHEN (l.side = 1 AND b.low <= l.sl) OR (l.side = -1 AND b.high >= l.sl) THEN b.pos END) AS lose
          FROM ev l LEFT JOIN bars b ON b.symbol = l.symbol AND b.pos > l.pos AND b.pos <= l.pos + l.horizon
          GROUP BY l.run_id, l.symbol, l.pos),
        done AS (SELECT l.*, CASE WHEN lose IS NOT NULL AND (win IS NULL OR lose <= win) THEN -1
            WHEN win IS NOT NULL THEN 1 ELSE 0 END AS label,
            least(coalesce(least(win, lose), l.pos + l.horizon), e.last_pos) AS exit_idx
          FROM ev l JOIN touch t ON t.run_id = l.run_id AND t.symbol = l.symbol AND t.pos = l.pos
          JOIN ends e ON e.symbol = l.symbol)""",
    ) + """SELECT d.run_id, count(*) AS n_events, round(avg((label = 1)::INT), 6) AS label_1_rate,
      round(avg((label = -1)::INT), 6) AS label_neg1_rate, round(avg((label = 0)::INT), 6) AS label_0_rate,
      round(avg(side * ln(b.close / entry_price)), 6) + 0.0 AS mean_return, round(avg(exit_idx - d.pos), 6) AS mean_bars_held
    FROM done d JOIN bars b ON b.symbol = d.symbol AND b.pos = d.exit_idx GROUP BY d.run_id"""


@register("sweep_dataset", _dataset_sweep_sql())
def sweep_dataset(spark, sf):
    out = P.sweep_dataset(event_bars(spark, sf), DATA_GRID)
    return rounded(out.select(
        "run_id", "n_events", "label_1_rate", "label_neg1_rate", "label_0_rate", "mean_return", "mean_bars_held"
    ))


FRAGILE_GRID = {"side": ["up", "down", "sideways", "broken"], "least": [0.0, 50.0]}


def _moves(bars: DataFrame, combos) -> DataFrame:
    """Bars that move one way by more than a limit; a side that is not known fails at once, a broken one while it runs."""
    parts = []
    for i, c in combos.items():
        if c["side"] not in ("up", "down", "broken"):
            raise ValueError(f"no such side: {c['side']}")
        move = F.col("close") - F.col("open") if c["side"] == "up" else F.col("open") - F.col("close")
        rows = bars.filter(move > c["least"])
        if c["side"] == "broken":
            rows = rows.filter(F.raise_error(F.concat(F.lit("broken at "), "symbol")).isNull())
        parts.append(rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(move), 6).alias("moved")).withColumn("run_id", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


@register(
    "sweep_failures",
    ctes(event_bars_sql(), """
    params AS (SELECT CAST(2 * s + l AS INTEGER) AS run_id, side, least FROM
      (VALUES (0, 'up'), (1, 'down'), (2, 'sideways'), (3, 'broken')) a(s, side), (VALUES (0, 0.0::DOUBLE), (1, 50.0::DOUBLE)) b(l, least)),
    moves AS (SELECT run_id, CASE side WHEN 'up' THEN close - open ELSE open - close END AS move, least FROM bars, params WHERE side IN ('up', 'down'))""")
    + """SELECT p.run_id, p.side, p.least, CASE WHEN side IN ('up', 'down') THEN count(move) END AS n, round(sum(move), 6) AS moved,
      side NOT IN ('up', 'down') AS failed
    FROM params p LEFT JOIN moves m ON m.run_id = p.run_id AND m.move > p.least GROUP BY p.run_id, p.side, p.least""",
)
def sweep_failures(spark, sf):
    out = P.sweep(event_bars(spark, sf), FRAGILE_GRID, _moves)
    return out.select("run_id", "side", "least", "n", "moved", F.col("error").isNotNull().alias("failed"))


BAD_GRID = {"horizon": [0, 36], "tp": [-0.01, 0.01], "sl": -0.005, "entry_period": [20], "intensity_threshold": 0.0}


@register(
    "sweep_dataset_errors",
    "SELECT *, NULL::VARCHAR AS error FROM ("
    + _dataset_sweep_sql({3: {"horizon": 36, "entry_period": 20, "intensity_threshold": 0.0}})
    + """) UNION ALL SELECT run_id, 0, NULL, NULL, NULL, NULL, NULL, error FROM (VALUES (0, 'horizon must be at least 1'),
      (1, 'horizon must be at least 1'), (2, 'tp must be above 0')) v(run_id, error)""",
)
def sweep_dataset_errors(spark, sf):
    out = P.sweep_dataset(event_bars(spark, sf), BAD_GRID)
    return rounded(out.select(
        "run_id", "n_events", "label_1_rate", "label_neg1_rate", "label_0_rate", "mean_return", "mean_bars_held", "error"
    ))


SPLIT_MS = 1_705_536_000_000  # 2024-01-18


def _half(bars: DataFrame, train: bool) -> DataFrame:
    """One side of the split with its own positions."""
    t = F.col("open_time")
    part = bars.filter(t < SPLIT_MS if train else t >= SPLIT_MS)
    first = part.groupBy("symbol").agg(F.min("pos").alias("_first"))
    return part.join(first, "symbol").withColumn("pos", F.col("pos") - F.col("_first")).drop("_first")


def _prefixed(sql: str, tag: str, names: str) -> str:
    import re

    for n in names.split():
        sql = re.sub(rf"\b{n}\b", f"{tag}_{n}", sql)
    return sql


def _train_test_sql() -> str:
    names = "chan0 chan perrun sig ent exits cand jump steps fold tried trades marked curve pts numbered curve_stats trade_stats metrics shown"
    parts = [event_bars_sql()]
    for tag, keep in (("tr", "<"), ("te", ">=")):
        parts.append(f"""{tag}_bars AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos
          FROM bars WHERE open_time {keep} {SPLIT_MS})""")
        for sql in (runs_sql(_COUPLED, f"{tag}_bars"), fold_sql(COST), CURVE_SQL, metrics_sql(COST, BARS_PER_YEAR), _SHOWN):
            parts.append(_prefixed(sql, tag, names))
    return ctes(*parts, recursive=True) + """SELECT a.run_id, a.symbol, a.sharpe AS train_sharpe, b.sharpe AS test_sharpe,
      b.max_dd_pct AS test_max_dd_pct, b.total_return_pct AS test_return_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe - 0.02::DOUBLE * max_dd_pct DESC, run_id) AS rk
          FROM tr_shown) a JOIN te_shown b ON b.run_id = a.run_id AND b.symbol = a.symbol WHERE rk <= 3"""


@register("train_test_topk", _train_test_sql())
def train_test(spark, sf):
    bars = cut(event_bars(spark, sf))
    out = P.train_test_topk(_half(bars, True), _half(bars, False), COUPLED_GRID, k=3, **OPTIONS)
    return out.select("run_id", "symbol", "train_sharpe", "test_sharpe", "test_max_dd_pct", "test_return_pct")


# ---- sizes, gates, orders, ledger ----------------------------------------------------------------

_SIG = ctes(event_bars_sql(), runs_sql(ONE_RUN))


def _entries(spark, sf) -> DataFrame:
    prepared = P.channel_table(event_bars(spark, sf), ONE_RUN)
    return run_signals(prepared, ONE_RUN).filter(F.abs("signal") == 1)


@register(
    "size_vol_target",
    _SIG + """SELECT symbol, pos, round(CASE WHEN s >= 0.001 THEN s ELSE 0 END, 6) AS size FROM (SELECT symbol, pos,
      floor(least(10000 * 0.01::DOUBLE / (mult * atr), 10000 * 20::DOUBLE / entry_price) / 0.001::DOUBLE) * 0.001::DOUBLE AS s FROM ent)""",
)
def size_vol_target(spark, sf):
    size = Z.vol_target_size(F.lit(10_000.0), F.col("atr"), F.col("close"), F.col("atr_mult"), risk_pct=0.01)
    return rounded(_entries(spark, sf).select("symbol", "pos", size.alias("size")))


@register(
    "size_stop_distance",
    _SIG + """SELECT symbol, pos, action, round(CASE WHEN stop > 0 AND ((action = 'BUY' AND stop < entry_price)
        OR (action = 'SELL' AND stop > entry_price)) THEN
        floor(least(10000 * 0.02::DOUBLE / abs(entry_price - stop), 10000 * 20::DOUBLE / entry_price) * 1000) / 1000
        ELSE 0 END, 6) AS size FROM (SELECT *, CASE WHEN (side = 1) = (pos % 3 <> 0) THEN 'BUY' ELSE 'SELL' END AS action FROM ent)""",
)
def size_stop_distance(spark, sf):
    # Every third position carries the wrong direction, which the size must refuse.
    e = _entries(spark, sf)
    action = F.when((F.col("signal") == 1) == (F.col("pos") % 3 != 0), "BUY").otherwise("SELL")
    size = Z.stop_distance_size(F.col("action"), F.lit(10_000.0), F.col("close"), F.col("stop_price"))
    return rounded(e.withColumn("action", action).select("symbol", "pos", "action", size.alias("size")))


@register(
    "gate_drawdown",
    backtest_sql(
        ONE_RUN,
        """SELECT symbol, pos, allowed FROM (SELECT symbol, pos, (peak - equity) / peak < 0.05 AS allowed
        FROM (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS peak
              FROM curve))""",
        CURVE_SQL,
    ),
)
def gate_drawdown(spark, sf):
    dd = drawdown(cut(_curve(spark, sf)))
    return dd.select("symbol", "pos", O.drawdown_gate((F.col("peak") - F.col("equity")) / F.col("peak")).alias("allowed"))


# Accounts and orders read from the event stream: purchases move the position of a user, views and clicks
# are commands, errors leave an order pending and signups clear it.
_ORDER_SQL = """
cmd AS (
  SELECT user_id, event_id, event_type, value, (epoch_us(ts)) AS us,
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END
         WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'CLOSE_LONG' ELSE 'CLOSE_SHORT' END END AS action,
    last_value(CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN value ELSE -value END END
      IGNORE NULLS) OVER w AS position,
    last_value(CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN false END IGNORE NULLS) OVER w AS pending
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
"""


@register(
    "order_admission",
    ctes(_ORDER_SQL, """
state AS (
  SELECT *, coalesce(position, 0) AS p, coalesce(pending, false) AS pend, position IS NULL OR pending IS NULL AS unsure,
         floor(value / 50 * 1000) / 1000 AS size FROM cmd WHERE action IS NOT NULL),
reasons AS (
  SELECT *, action IN ('BUY', 'SELL') AS opening,
    CASE WHEN unsure THEN 'unknown_state'
         WHEN action IN ('BUY', 'SELL') AND abs(p) >= 0.001 THEN 'in_position'
         WHEN action IN ('BUY', 'SELL') AND pend THEN 'pending_order'
         WHEN action IN ('BUY', 'SELL') AND size <= 0 THEN 'no_size'
         WHEN action = 'CLOSE_LONG' AND p < 0.001 THEN 'no_long'
         WHEN action = 'CLOSE_SHORT' AND p > -0.001 THEN 'no_short' ELSE 'ok' END AS reason FROM state)""")
    + """SELECT user_id, event_id, action, reason, reason = 'ok' AS admitted, reason = 'ok' AND NOT opening AS reduce_only,
      CASE WHEN reason = 'ok' THEN CASE action WHEN 'CLOSE_LONG' THEN 'SELL' WHEN 'CLOSE_SHORT' THEN 'BUY' ELSE action END END AS side,
      round(CASE WHEN reason <> 'ok' THEN 0 WHEN opening THEN size ELSE abs(p) END, 6) + 0.0 AS quantity,
      NOT pend AND abs(p) <= 1e-8 AS gate_open FROM reasons""",
)
def order_admission(spark, sf):
    e = table(spark, sf, "events")
    odd, kind = F.col("event_id") % 2, F.col("event_type")
    third = F.col("event_id") % 3
    moved = F.when(third == 0, 0.0).when(third == 1, F.col("value")).otherwise(-F.col("value"))
    rows = e.select(
        "user_id", "event_id", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(kind == "view", F.when(odd == 0, "BUY").otherwise("SELL"))
        .when(kind == "click", F.when(odd == 0, "CLOSE_LONG").otherwise("CLOSE_SHORT")).alias("action"),
        F.when(kind == "purchase", moved).alias("_moved"),
        F.when(kind == "error", F.lit(True)).when(kind == "signup", F.lit(False)).alias("_pending"),
    ).withColumn("_day", F.floor(F.col("us") / 86_400_000_000))
    known = running(
        rows, ["user_id"], "_day", "us",
        [Running("position", "last", F.col("_moved")), Running("pending", "last", F.col("_pending"))],
    ).filter("action IS NOT NULL")
    position, pending = F.col("position"), F.col("pending")  # NULL for a user without such an event so far
    size = Z.floor_quantity(F.col("value") / 50)
    out = known.select(
        "user_id", "event_id", "action", O.admission(F.col("action"), position, pending, size).alias("a"),
        O.position_gate(position, pending).alias("gate_open"),
    )
    return rounded(out.select("user_id", "event_id", "action", "a.*", "gate_open"))


@register(
    "order_intents",
    _SIG + """SELECT symbol, pos, round(round(entry_price * 100) / 100, 6) AS price, round(stop, 6) AS stop_price,
      floor(floor(least(10000 * 0.02::DOUBLE / abs(entry_price - stop), 10000 * 20::DOUBLE / entry_price) * 1000) / 1000 * 1000) / 1000 AS quantity,
      CASE WHEN side = 1 THEN 'BUY' ELSE 'SELL' END AS action, 'donchian_low' AS indicator, 10 AS period,
      CASE WHEN pos % 2 = 0 THEN round(entry_price * 2, 6) END AS take_profit, pos % 2 = 0 AS has_take_profit FROM ent""",
)
def order_intents(spark, sf):
    e = _entries(spark, sf)
    raw = Z.risk_size(F.lit(10_000.0), F.col("close"), F.col("stop_price"))
    price, qty = O.exchange_rounding(F.col("close"), raw)
    intent = O.order_intent(
        F.when(F.col("signal") == 1, "BUY").otherwise("SELL"), F.col("symbol"), qty, price,
        F.col("stop_price"), F.col("pos").cast("double"), period=10,
        take_profit=F.when(F.col("pos") % 2 == 0, F.col("close") * 2),
    )
    text = e.select("symbol", "pos", O.intent_json(intent).alias("js"))
    schema = "action string, quantity double, price double, stop_price double, trailing_exit struct<indicator:string,period:int>, take_profit double"
    parsed = text.select("symbol", "pos", F.from_json("js", schema).alias("i"),
                         F.col("js").contains("take_profit").alias("has_take_profit"))
    return rounded(parsed.select(
        "symbol", "pos", "i.price", "i.stop_price", "i.quantity", "i.action", "i.trailing_exit.indicator",
        "i.trailing_exit.period", "i.take_profit", "has_take_profit",
    ))


_LEDGER_SQL = """
fills AS (
  SELECT event_type AS account, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
    epoch_us(ts) // 1000 AS timestamp_ms, CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    floor(value / 10 * 1000) / 1000 AS quantity, 100 + value AS price, user_id % 5 = 0 AS reduce_only FROM events),
ledger AS (
  SELECT account, CAST(0 AS BIGINT) AS seq, CAST(10000 AS DOUBLE) AS balance, CAST(0 AS DOUBLE) AS position, CAST(0 AS DOUBLE) AS entry,
    CAST(NULL AS BIGINT) AS timestamp_ms, CAST(NULL AS VARCHAR) AS side, CAST(0 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS price,
    CAST(0 AS DOUBLE) AS fee, CAST(0 AS DOUBLE) AS pnl, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT account FROM fills)
  UNION ALL
  SELECT account, seq, CASE WHEN reason IS NULL THEN balance ELSE balance + pnl - fp * qty * 0.0005::DOUBLE END,
    CASE WHEN abs(new_pos) < 0.001 THEN 0 ELSE new_pos END,
    CASE WHEN reason = 'open' THEN new_entry WHEN abs(new_pos) < 0.001 THEN 0 ELSE entry END,
    timestamp_ms, side, qty, fp, fp * qty * 0.0005::DOUBLE, pnl, reason
  FROM (
    SELECT *, CASE WHEN reason IS NULL THEN position WHEN reason = 'open' THEN position + sgn * qty ELSE position - sign(position) * qty END AS new_pos,
      CASE WHEN reason = 'close' THEN sign(position) * (fp - entry) * qty ELSE 0 END AS pnl,
      CASE WHEN position = 0 THEN fp ELSE (entry * abs(position) + fp * qty) / (abs(position) + qty) END AS new_entry
    FROM (
      SELECT l.account, f.seq, l.balance, l.position, l.entry, f.timestamp_ms, f.side, g.sgn, g.fp,
        CASE WHEN f.quantity <= 0 THEN NULL WHEN f.reduce_only OR g.sgn * l.position < 0
             THEN CASE WHEN l.position <> 0 THEN 'close' END ELSE 'open' END AS reason,
        CASE WHEN f.reduce_only OR g.sgn * l.position < 0 THEN least(f.quantity, abs(l.position)) ELSE f.quantity END AS qty
      FROM ledger l JOIN fills f ON f.account = l.account AND f.seq = l.seq + 1
      JOIN (SELECT account, seq, CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS sgn,
              price * (1 + CASE side WHEN 'BUY' THEN 0.0001::DOUBLE ELSE -0.0001::DOUBLE END) AS fp FROM fills) g
        ON g.account = f.account AND g.seq = f.seq)))
"""


@register(
    "fill_ledger",
    ctes(_LEDGER_SQL, recursive=True)
    + f"""SELECT account, seq, timestamp_ms, side, reason, {r6('quantity price fee pnl')},
    round(balance, 6) AS balance_after, round(position, 6) + 0.0 AS position_after FROM ledger WHERE reason IS NOT NULL""",
)
def ledger(spark, sf):
    from sparkbars.operators.running import row_index
    from sparkbars.sources.bars import epoch_ms

    e = table(spark, sf, "events").select(
        F.col("event_type").alias("account"), F.col("event_type").alias("symbol"), "ts", "event_id",
        epoch_ms("ts").alias("timestamp_ms"),
        F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        Z.floor_quantity(F.col("value") / 10).alias("quantity"),
        (F.col("value") + 100).alias("price"),
        (F.col("user_id") % 5 == 0).alias("reduce_only"),
    ).withColumn("_day", F.floor(F.col("timestamp_ms") / 86_400_000))
    orders = row_index(e, ["account"], "_day", ["ts", "event_id"], "seq").withColumn("seq", F.col("seq") + 1)
    return rounded(fill_ledger(orders).drop("symbol"))
