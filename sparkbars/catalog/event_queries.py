"""Signals, features, labels and datasets of breakout events."""

from pyspark.sql import functions as F

from sparkbars.catalog.bar_queries import EVENT_IND, INDICATORS_SQL, event_indicators
from sparkbars.catalog.inputs import event_bars_sql
from sparkbars.catalog.registry import ctes, r6, register, rounded
from sparkbars.functions import features as X
from sparkbars.functions import signals as S
from sparkbars.operators import dataset as D
from sparkbars.operators.labels import (
    event_rows,
    fixed_horizon_labeler,
    label_fixed_horizon,
    label_triple_barrier,
    triple_barrier_labeler,
)
from sparkbars.session import cut

THRESHOLD = 0.5
HORIZON = 72
BARRIERS = dict(upper_barrier=0.01, lower_barrier=-0.005, horizon=HORIZON)
ATR_BARRIERS = dict(upper_barrier=2.0, lower_barrier=-1.0, horizon=HORIZON, barrier_mode="atr")

EVENTS_SQL = f"""
unit AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE 1.0 END AS valid_atr FROM ind),
intense AS (
  SELECT *, (close - entry_high) / valid_atr AS up, (entry_low - close) / valid_atr AS down FROM unit),
signals AS (
  SELECT *, CASE WHEN close < entry_low AND down > {THRESHOLD} THEN -1
                 WHEN close > entry_high AND up > {THRESHOLD} THEN 1 ELSE 0 END AS signal FROM intense),
ev AS (SELECT *, signal AS side, close AS entry_price FROM signals WHERE signal <> 0),
ends AS (SELECT symbol, max(pos) AS last_pos FROM bars GROUP BY symbol)
"""
EVENT_SQL = ctes(event_bars_sql(), INDICATORS_SQL, EVENTS_SQL)


def signal():
    return S.breakout_event(THRESHOLD)


def events(spark, sf):
    return event_rows(event_indicators(spark, sf), signal())


@register(
    "trigger_breakout",
    EVENT_SQL + f"""SELECT symbol, pos, open_time, side, {r6('close entry_high entry_low atr')},
    round(CASE WHEN side = 1 THEN up ELSE down END, 6) AS intensity FROM ev""",
)
def trigger_breakout(spark, sf):
    up, down = S.intensities(F.col("close"), F.col("entry_high"), F.col("entry_low"), F.col("atr"))
    rows = events(spark, sf).select(
        "symbol", "pos", "open_time", "side", "close", "entry_high", "entry_low", "atr",
        F.when(F.col("side") == 1, up).otherwise(down).alias("intensity"),
    )
    return rounded(rows)


FIVE_WAY_SQL = """
five AS (
  SELECT *, CASE WHEN close < entry_low AND down > {t} THEN -1 WHEN close > entry_high AND up > {t} THEN 1
                 WHEN close > exit_high THEN -2 WHEN close < exit_low THEN 2 ELSE 0 END AS code,
         CASE WHEN up > {t} THEN 1 WHEN down > {t} THEN -1
              WHEN close < exit_low THEN 2 WHEN close > exit_high THEN -2 ELSE 0 END AS last_code FROM intense)
"""


@register(
    "signals_five_way",
    ctes(event_bars_sql(), INDICATORS_SQL, EVENTS_SQL, FIVE_WAY_SQL.format(t=0.0))
    + """SELECT symbol, pos, code, last_code,
    round(CASE last_code WHEN 1 THEN close - atr * 2 WHEN -1 THEN close + atr * 2 END, 6) AS stop_price
    FROM five WHERE pos >= 21""",
)
def signals_five_way(spark, sf):
    bars = event_indicators(spark, sf).filter(F.col("pos") >= S.warmup_bars(20, 20))
    args = [F.col(c) for c in ("close", "entry_high", "entry_low", "exit_high", "exit_low", "atr")]
    last = S.last_bar_signal(*args, 0.0)
    return rounded(bars.select(
        "symbol", "pos", S.five_way(*args, 0.0).alias("code"), last.alias("last_code"),
        S.stop_level(last, F.col("close"), F.col("atr"), 2.0).alias("stop_price"),
    ))


@register(
    "events_aligned",
    EVENT_SQL + "SELECT symbol, pos, signal, signal <> 0 AS unsigned FROM signals",
)
def events_aligned(spark, sf):
    bars = cut(event_indicators(spark, sf).select("symbol", "pos", "close", "entry_high", "entry_low", "atr"))
    dense = D.align_events(bars, event_rows(bars, signal()))
    unsigned = S.breakout_event(THRESHOLD, signed=False)
    return dense.select("symbol", "pos", "signal", unsigned.alias("unsigned"))


FEATURES = (
    "atr atr_pct long_intensity short_intensity vol_ratio vol_zscore channel_pos channel_width_pct "
    "ret_5 ret_10 ret_30 taker_buy_ratio trend_direction ma_ratio"
)
FEATURES_SQL = """
feat AS (
  SELECT symbol, pos, coalesce(atr, 0) AS atr, CASE WHEN close > 0 THEN coalesce(atr, 0) / close ELSE 0 END AS atr_pct,
    coalesce(up, 0) AS long_intensity, coalesce(down, 0) AS short_intensity,
    coalesce(vol_ratio, 1) AS vol_ratio, coalesce(vol_zscore, 0) AS vol_zscore, coalesce(channel_pos, 0.5) AS channel_pos,
    CASE WHEN close > 0 THEN coalesce((entry_high - entry_low) / close, 0) ELSE 0 END AS channel_width_pct,
    coalesce(ret_5, 0) AS ret_5, coalesce(ret_10, 0) AS ret_10, coalesce(ret_30, 0) AS ret_30,
    coalesce(taker_buy_ratio, 0.5) AS taker_buy_ratio,
    CASE WHEN ma > 0 AND close / ma > 1.01 THEN 1::DOUBLE WHEN ma > 0 AND close / ma < 0.99 THEN -1::DOUBLE ELSE 0::DOUBLE END AS trend_direction,
    CASE WHEN ma > 0 THEN close / ma ELSE 1 END AS ma_ratio,
    CAST((open_time // 3600000) % 24 AS DOUBLE) AS hour_of_day
  FROM {source})
"""


@register(
    "features_default",
    EVENT_SQL.rstrip() + "," + FEATURES_SQL.format(source="ev") + f"SELECT symbol, pos, {r6(FEATURES)} FROM feat",
)
def features_default(spark, sf):
    return rounded(X.compute_features(events(spark, sf), X.default_feature_set()))


@register(
    "features_every_bar",
    EVENT_SQL.rstrip() + "," + FEATURES_SQL.format(source="intense")
    + f"SELECT symbol, pos, {r6(FEATURES)} FROM feat",
)
def features_every_bar(spark, sf):
    return rounded(X.compute_features(event_indicators(spark, sf), X.default_feature_set()))


@register("feature_hour", EVENT_SQL + "SELECT symbol, pos, CAST((open_time // 3600000) % 24 AS DOUBLE) AS hour_of_day FROM ev")
def feature_hour(spark, sf):
    return X.compute_features(events(spark, sf), X.compose([X.hour_of_day]))


def _event_table(spark, sf, columns: str = "*"):
    """The indicator table, written with the columns a query reads."""
    return cut(event_indicators(spark, sf).select(*columns.split()))


_BAR_EVENT = "symbol pos high low close entry_high entry_low atr"


def triple_sql(profit: str, stop: str, ret_atr: str) -> str:
    """First touch by a plain range join."""
    return f"""
levels AS (SELECT *, {profit} AS tp, {stop} AS sl FROM ev),
touch AS (
  SELECT l.symbol, l.pos,
    min(CASE WHEN (l.side = 1 AND b.high >= l.tp) OR (l.side = -1 AND b.low <= l.tp) THEN b.pos END) AS win,
    min(CASE WHEN (l.side = 1 AND b.low <= l.sl) OR (l.side = -1 AND b.high >= l.sl) THEN b.pos END) AS lose
  FROM levels l LEFT JOIN bars b ON b.symbol = l.symbol AND b.pos BETWEEN l.pos + 1 AND l.pos + {HORIZON}
  GROUP BY l.symbol, l.pos),
decided AS (
  SELECT l.*, e.last_pos, CASE WHEN lose IS NOT NULL AND (win IS NULL OR lose <= win) THEN -1
                             WHEN win IS NOT NULL THEN 1 ELSE 0 END AS label,
    coalesce(least(win, lose), l.pos + {HORIZON}) AS raw_exit
  FROM levels l JOIN touch t ON l.symbol = t.symbol AND l.pos = t.pos JOIN ends e ON l.symbol = e.symbol),
lab AS (
  SELECT d.symbol, d.pos, d.label, CASE d.label WHEN 1 THEN 'upper' WHEN -1 THEN 'lower' ELSE 'timeout' END AS barrier_hit,
    least(raw_exit, last_pos) AS exit_idx, least(raw_exit, last_pos) - d.pos AS n_bars_held, d.entry_price,
    b.close AS exit_price, d.side * ln(b.close / d.entry_price) AS actual_return,
    {ret_atr} AS return_atr, raw_exit > last_pos AS truncated
  FROM decided d JOIN bars b ON b.symbol = d.symbol AND b.pos = least(raw_exit, last_pos))
"""


_PCT_SQL = triple_sql(
    "CASE WHEN side = 1 THEN entry_price * 1.01::DOUBLE ELSE entry_price / 1.01::DOUBLE END",
    "CASE WHEN side = 1 THEN entry_price * 0.995::DOUBLE ELSE entry_price / 0.995::DOUBLE END",
    "CAST(NULL AS DOUBLE)",
)
_ATR_SQL = triple_sql(
    "CASE WHEN side = 1 THEN greatest(entry_price + 2 * atr, entry_price + 1e-8) ELSE least(entry_price - 2 * atr, entry_price - 1e-8) END",
    "CASE WHEN side = 1 THEN least(entry_price - atr, entry_price - 1e-8) ELSE greatest(entry_price + atr, entry_price + 1e-8) END",
    "d.side * (b.close - d.entry_price) / CASE WHEN d.atr > 1e-12 THEN d.atr ELSE 1 END",
)
_LABEL_SELECT = (
    "symbol, pos, label, barrier_hit, exit_idx, n_bars_held, truncated, "
    + r6("entry_price exit_price actual_return return_atr")
)


@register("label_triple_pct", EVENT_SQL.rstrip() + "," + _PCT_SQL + f"SELECT {_LABEL_SELECT} FROM lab")
def label_triple_pct(spark, sf):
    bars = _event_table(spark, sf, _BAR_EVENT)
    return rounded(label_triple_barrier(bars, event_rows(bars, signal()), **BARRIERS))


@register("label_triple_atr", EVENT_SQL.rstrip() + "," + _ATR_SQL + f"SELECT {_LABEL_SELECT} FROM lab")
def label_triple_atr(spark, sf):
    bars = _event_table(spark, sf, _BAR_EVENT)
    return rounded(label_triple_barrier(bars, event_rows(bars, signal()), **ATR_BARRIERS))


FIXED_SQL = f"""
fixed AS (
  SELECT v.*, least(v.pos + {HORIZON}, e.last_pos) AS exit_idx, b.close AS exit_price,
    v.side * (b.close - v.close) / v.close AS raw_return, v.pos + {HORIZON} > e.last_pos AS truncated
  FROM ev v JOIN ends e ON v.symbol = e.symbol
  JOIN bars b ON b.symbol = v.symbol AND b.pos = least(v.pos + {HORIZON}, e.last_pos)),
fixed_lab AS (
  SELECT *, raw_return / CASE WHEN atr_daily > 1e-12 THEN atr_daily ELSE 1 END AS y_norm FROM fixed),
common AS (
  SELECT symbol, pos, open_time AS event_time, CAST(sign(y_norm) AS INTEGER) AS label, 'fixed_horizon' AS barrier_hit, exit_idx,
    exit_idx - pos AS n_bars_held, entry_price, exit_price, raw_return AS actual_return, y_norm AS return_atr,
    truncated, y_norm, raw_return, side
  FROM fixed_lab)
"""


@register(
    "label_fixed_horizon",
    EVENT_SQL.rstrip() + "," + FIXED_SQL
    + f"SELECT symbol, pos, exit_idx, truncated, {r6('y_norm raw_return entry_price exit_price')} FROM fixed_lab",
)
def fixed_horizon(spark, sf):
    bars = _event_table(spark, sf, _BAR_EVENT + " atr_daily")
    return rounded(label_fixed_horizon(bars, event_rows(bars, signal()), HORIZON))


DATASET_SQL = EVENT_SQL.rstrip() + "," + FEATURES_SQL.format(source="ev").rstrip() + "," + FIXED_SQL.rstrip() + """,
dataset AS (SELECT c.*, f.* EXCLUDE (symbol, pos) FROM common c JOIN feat f ON f.symbol = c.symbol AND f.pos = c.pos)
"""


def fixed_dataset(spark, sf):
    """Events with default features and fixed-horizon labels."""
    return D.build_dataset(_event_table(spark, sf), signal(), X.default_feature_set(), fixed_horizon_labeler(HORIZON))


@register(
    "ml_dataset",
    DATASET_SQL + f"""SELECT symbol, pos, event_time, side, label, barrier_hit, exit_idx, n_bars_held, truncated,
    {r6('entry_price exit_price actual_return return_atr y_norm raw_return')}, {r6(FEATURES)} FROM dataset""",
)
def ml_dataset(spark, sf):
    return rounded(fixed_dataset(spark, sf))


@register(
    "ml_dataset_barriers",
    EVENT_SQL.rstrip() + "," + FEATURES_SQL.format(source="ev").rstrip() + "," + _PCT_SQL
    + f"SELECT f.symbol, f.pos, label, barrier_hit, n_bars_held, {r6('actual_return', 'l')}, {r6(FEATURES, 'f')} "
    + "FROM feat f LEFT JOIN lab l ON l.symbol = f.symbol AND l.pos = f.pos",
)
def ml_dataset_barriers(spark, sf):
    rows = D.features_with_labels(
        _event_table(spark, sf), signal(), X.default_feature_set(), triple_barrier_labeler(**BARRIERS)
    )
    return rounded(rows.select("symbol", "pos", "label", "barrier_hit", "n_bars_held", "actual_return", *FEATURES.split()))


@register(
    "dataset_meta",
    EVENT_SQL.rstrip() + "," + _PCT_SQL + """SELECT count(*) AS n_events, count(label) AS n_events_labeled,
      count(*) FILTER (truncated) AS n_truncated, round(count(*) / (SELECT count(*) FROM bars), 6) AS coverage,
      count(*) FILTER (label = 1) AS n_up, count(*) FILTER (label = -1) AS n_down, count(*) FILTER (label = 0) AS n_flat,
      round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END), 6) AS up_rate,
      count(*) FILTER (barrier_hit = 'upper') AS n_upper, count(*) FILTER (barrier_hit = 'lower') AS n_lower,
      count(*) FILTER (barrier_hit = 'timeout') AS n_timeout,
      round(avg(actual_return), 6) + 0.0 AS mean_actual_return, round(median(actual_return), 6) + 0.0 AS median_actual_return,
      round(avg(n_bars_held), 6) AS mean_n_bars_held, '""" + ",".join(FEATURES.split()) + """' AS feature_names FROM lab""",
)
def dataset_meta(spark, sf):
    bars = _event_table(spark, sf)
    data = cut(D.build_dataset(bars, signal(), X.default_feature_set(), triple_barrier_labeler(**BARRIERS)))
    zero = F.lit(0).cast("long")
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), zero)
    return rounded(D.dataset_meta(data, bars).select(
        "n_events", "n_events_labeled", "n_truncated", "coverage",
        *[at("label_counts", k).alias(n) for k, n in ((1, "n_up"), (-1, "n_down"), (0, "n_flat"))],
        F.coalesce(F.try_element_at("label_rates", F.lit(1)), F.lit(0.0)).alias("up_rate"),
        *[at("barrier_hit_counts", b).alias(f"n_{b}") for b in ("upper", "lower", "timeout")],
        "mean_actual_return", "median_actual_return", "mean_n_bars_held", F.array_join("feature_names", ",").alias("feature_names"),
    ))


@register(
    "period_stats",
    DATASET_SQL + """SELECT CAST(year(make_timestamp(event_time * 1000)) AS INTEGER) AS year, count(*) AS events,
      round(avg(CASE WHEN y_norm > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(y_norm), 6) AS avg_y_norm,
      round(median(y_norm), 6) AS median_y_norm, round(avg(raw_return), 6) AS avg_raw_return
    FROM dataset GROUP BY 1""",
)
def period_stats(spark, sf):
    return rounded(D.period_stats(cut(fixed_dataset(spark, sf))))
