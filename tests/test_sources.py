import glob
import pathlib
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators.running import Running, row_index, running
from sparkbars.schema import CSV_COLUMNS, LEDGER_COLUMNS
from sparkbars.session import CHECKPOINT_DIR, cut, scratch_root
from sparkbars.sources import bars as B
from sparkbars.sources import sinks
from sparkbars.sources.bars import merge_increments
from tests.data import frame, walk


def _klines(n=50, symbol=None):
    d = walk(3, n)
    d["close_time"] = d.open_time + 59_999
    d["quote_volume"], d["taker_buy_quote"] = d.volume * d.close, d.taker_buy_base * d.close
    return d[CSV_COLUMNS] if symbol is None else d[CSV_COLUMNS].assign(symbol=symbol)


def test_load_by_suffix_and_range(spark, tmp_path):
    k = _klines()
    k["datetime"] = pd.to_datetime(k.open_time, unit="ms")
    k.to_parquet(tmp_path / "b.parquet")
    k[CSV_COLUMNS].to_csv(tmp_path / "b.csv", index=False)
    full = B.load_bars(spark, str(tmp_path / "b.parquet"))
    part = B.load_bars(spark, str(tmp_path / "b.parquet"), ["2023-01-01 00:10:00", "2023-01-01 00:20:00"])
    assert (full.count(), part.count()) == (50, 10)
    assert dict(full.dtypes)["datetime"] == "timestamp_ntz"
    assert full.agg(F.min(F.unix_millis(F.col("datetime").cast("timestamp")))).first()[0] == k.open_time[0]
    assert part.agg(F.max("open_time")).first()[0] == k.open_time[19]
    assert "PushedFilters: [IsNotNull(datetime), GreaterThanOrEqual(datetime" in part._jdf.queryExecution().executedPlan().toString()
    text = B.load_bars(spark, str(tmp_path / "b.csv"), ["2023-01-01 00:10:00", "2023-01-01 00:20:00"])
    assert text.count() == 10 and dict(text.dtypes)["open_time"] == "bigint"
    with pytest.raises(ValueError):
        B.load_bars(spark, "bars.orc")


def test_normalize_positional_and_bad_text(spark):
    rows = [("1000", "1", "2", "0.5", "x", "3", "1999", "4", "5", "6", "7", "0"), ("", *"12345678901")]
    raw = spark.createDataFrame(rows, [f"c{i}" for i in range(12)])
    out = B.normalize_klines(raw)
    assert out.columns == CSV_COLUMNS
    r = out.collect()
    assert len(r) == 1 and r[0]["open_time"] == 1000 and r[0]["close"] is None and r[0]["trades_count"] == 5


def test_merge_keeps_newest(spark):
    a = spark.createDataFrame([("X", 1, 1.0), ("X", 2, 2.0)], "symbol string, open_time long, close double")
    b = spark.createDataFrame([("X", 2, 9.0), ("X", 3, 3.0)], "symbol string, open_time long, close double")
    got = {(r.open_time, r.close) for r in B.merge_increments(a, b).collect()}
    assert got == {(1, 1.0), (2, 9.0), (3, 3.0)}
    assert "datetime" in B.merge_increments(a).columns


def test_resume_and_new_symbol(spark):
    schema = "symbol string, open_time long"
    have = spark.createDataFrame([("X", 0), ("X", 60_000)], schema)
    new = spark.createDataFrame([("X", 60_000), ("X", 90_000), ("X", 120_000), ("Y", 0)], schema)
    assert sorted(map(tuple, B.resume_increment(have, new).collect())) == [("X", 120_000), ("Y", 0)]


def test_funding_schemas(spark):
    old = B.normalize_funding(spark.createDataFrame([("1000", "0.1"), ("bad", "0.2")], "t string, r string"))
    new = B.normalize_funding(spark.createDataFrame([(1000, 8, 0.3), (2000, 8, None)],
                                                    "calc_time long, funding_interval int, last_funding_rate double"))
    got = [tuple(r)[1:] for r in B.merge_funding(old, new).collect()]
    assert got == [(1000, 0.3)]


def test_csv_export(spark, tmp_path):
    k = _klines()
    bars = frame(spark, pd.concat([k, k.iloc[:5]]))
    out = str(tmp_path / "csv")
    sinks.write_bars_csv(bars, out, int(k.open_time[2]), int(k.open_time[40]))
    files = sorted(glob.glob(f"{out}/*.csv"))
    back = pd.concat([pd.read_csv(f) for f in files])
    assert list(back.columns) == CSV_COLUMNS
    assert list(back.open_time) == list(k.open_time[2:41])
    with pytest.raises(ValueError):
        sinks.write_bars_csv(bars.drop("close_time"), out)


def test_sinks(spark, tmp_path):
    data = frame(spark, walk(1, 30).drop(columns=["open_time"]))
    sinks.write_dataset(data, str(tmp_path / "ds"))
    assert spark.read.parquet(str(tmp_path / "ds")).count() == 30
    for name in ("s.parquet", "s.csv"):
        sinks.write_sweep(data, str(tmp_path / name))
    assert spark.read.option("header", True).csv(str(tmp_path / "s.csv")).count() == 30
    row = (1, "X", "BUY", 0.5, 123.45678901234, 0.1, 0.0, 9999.123456789, 0.5, "open")
    ledger = spark.createDataFrame([row], "timestamp_ms long, symbol string, side string, quantity double, price double, "
                                          "fee double, pnl double, balance_after double, position_after double, reason string")
    sinks.write_ledger(ledger, str(tmp_path / "ledger"))
    back = spark.read.option("header", True).csv(str(tmp_path / "ledger"))
    assert back.columns == LEDGER_COLUMNS
    assert back.first()["price"] == "123.456789" and back.first()["balance_after"] == "9999.123457"


def test_positions_ignore_time_gaps(spark):
    times = [0, 60_000, 3 * 86_400_000, 3 * 86_400_000 + 5, 9 * 86_400_000]
    bars = spark.createDataFrame([(s, t) for s in "AB" for t in times[: 5 if s == "A" else 3]], "symbol string, open_time long")
    got = B.add_position(bars).toPandas().sort_values(["symbol", "open_time"])
    assert list(got.pos) == [0, 1, 2, 3, 4, 0, 1, 2]


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_plain_window(spark, reverse, exclusive):
    from pyspark.sql import Window as W

    pdf = walk(4, 120)[["symbol", "pos", "close"]]
    pdf.loc[pdf.pos % 3 == 0, "close"] = None
    df = frame(spark, pdf).withColumn("c", F.expr("pos div 17"))
    items = [Running("s", "sum", F.col("close")), Running("a", "max", F.col("close")), Running("i", "min", F.col("close")),
             Running("l", "last", F.col("close"))]
    got = running(df, ["symbol"], "c", "pos", items, reverse=reverse, exclusive=exclusive).toPandas().sort_values("pos")
    w = W.partitionBy("symbol").orderBy(F.col("pos").desc() if reverse else "pos").rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    want = df.select("pos", F.sum("close").over(w).alias("s"), F.max("close").over(w).alias("a"),
                     F.min("close").over(w).alias("i"), F.last("close", True).over(w).alias("l")).toPandas().sort_values("pos")
    for c in "sail":
        pd.testing.assert_series_equal(got[c].reset_index(drop=True), want[c].reset_index(drop=True), rtol=1e-12)


def test_row_index_without_key(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("c"), "id")
    got = row_index(df, [], "c", ["id"]).orderBy("c", "id").collect()
    assert [r.row_index for r in got] == list(range(100))


def test_cut_uses_the_shared_folder(spark):
    root = scratch_root(spark)
    named = spark.conf.get(CHECKPOINT_DIR, None)
    assert named is None or root == named
    table = cut(spark.range(5))
    assert table.count() == 5 and table.inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(root.removeprefix("file:"))


def test_cluster_without_shared_folder_is_refused():
    unset = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="spark://head:7077", getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError):
        scratch_root(unset)


def test_increments_touch_only_their_folders(spark, tmp_path):
    """Two symbols over three months; an increment changes one month of one symbol and adds another month."""
    day = 86_400_000
    start = 1_704_067_200_000  # 2024-01-01
    rows = [(s, start + i * day, float(i)) for s in "AB" for i in range(75)]
    bars = spark.createDataFrame(rows, "symbol string, open_time long, close double")
    path = str(tmp_path / "bars")
    sinks.merge_into(path, bars)
    files = lambda: {str(f.relative_to(path)) for f in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    assert {f.split("/part")[0] for f in before} == {f"symbol={s}/month=2024-0{m}" for s in "AB" for m in (1, 2, 3)}
    first = spark.createDataFrame([("A", start + 40 * day, -1.0), ("A", start + 95 * day, 95.0)], bars.schema)
    second = spark.createDataFrame([("A", start + 40 * day, -2.0)], bars.schema)
    sinks.merge_into(path, first, second)
    after = files()
    kept = {f for f in before if "symbol=A/month=2024-02" not in f}
    assert kept <= after and not (before - kept) & after
    got = sorted(map(tuple, spark.read.parquet(path).select("symbol", "open_time", "close").collect()))
    want = sorted(map(tuple, merge_increments(bars, first, second).select("symbol", "open_time", "close").collect()))
    assert got == want and ("A", start + 40 * day, -2.0) in got and len(got) == 151
