"""Hand-worked cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.functions import book, scalar
from lodestream.functions.windows import Rolling
from lodestream.operators import align, clean, models, resample, scan, structure, trading, validate
from lodestream.plans import engine
from lodestream.sources import storage
from lodestream.streaming import live

T0 = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="x", step=dt.timedelta(hours=1)):
    rows = [(symbol, T0 + step * k, float(c), float(c), float(c), float(c), 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def ticks(spark, rows):
    return spark.createDataFrame([("x", T0 + dt.timedelta(seconds=s), p, v, "buy", k) for k, (s, p, v) in enumerate(rows)], "symbol string, ts timestamp_ntz, price double, volume double, side string, sequence long")


def test_dedup_first_and_last(spark):
    t = ticks(spark, [(0, 1.0, 1.0), (0, 2.0, 1.0), (1, 3.0, 1.0)])
    assert [r.price for r in clean.dedup(t).orderBy("ts").collect()] == [1.0, 3.0]
    assert [r.price for r in clean.dedup(t, "last").orderBy("ts").collect()] == [2.0, 3.0]


def test_invalid_prices(spark):
    t = ticks(spark, [(0, 0.0, 1.0), (1, None, 1.0), (2, 5.0, -1.0), (3, 5.0, None), (4, 5.0, 0.0)])
    assert [r.sequence for r in t.filter(~clean.invalid()).collect()] == [4]


def test_empty_and_single(spark):
    t = ticks(spark, [])
    assert clean.clean(t).count() == 0 and resample.ohlcv(t, "1 hour").count() == 0
    one = resample.derived(resample.ohlcv(ticks(spark, [(5, 2.0, 3.0)]), "1 minute")).first()
    assert (one.open, one.close, one.volume_per_tick, one.ticks) == (2.0, 2.0, 3.0, 1)


def test_clean_counts_duplicates_by_the_keys(spark):
    t = ticks(spark, [(0, 1.0, 1.0), (0, 2.0, 1.0), (1, 3.0, 1.0), (2, -1.0, 1.0)])
    counts = lambda df: [(r.total, r.duplicates, r.invalid, r.outliers, r.kept) for r in df.collect()]
    assert counts(clean.clean_stats(t)) == [(4, 1, 1, 0, 2)] and counts(clean.clean_stats(t, keys=())) == [(4, 0, 1, 0, 3)]
    assert [clean.clean(t).count(), clean.clean(t, keys=()).count()] == [2, 3]


def test_sessions_by_hour(spark):
    rows = spark.range(24).select("id", scalar.market_session(F.lit(T0) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("s")).collect()
    want = ["asian"] * 8 + ["london"] * 5 + ["overlap"] * 4 + ["new_york"] * 5 + ["closed", "asian"]
    assert [r.s for r in sorted(rows, key=lambda r: r.id)] == want


def test_safe_divide(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (float("nan"), 1.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r.q for r in rows.select(scalar.safe_divide(F.col("a"), F.col("b"), -1.0).alias("q")).collect()] == [-1.0, -1.0, -1.0, 2.0, -1.0]


def test_book_integrity(spark):
    kind = "bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>"
    rows = [([(10, 1), (9, 1)], [(11, 1), (12, 1)]), ([(12, 1), (9, 1)], [(11, 1), (13, 1)]), ([(10, 1), (10.5, 1)], [(11, 1), (12, 1)]), ([(10, 0), (9, 1)], [(11, 1), (12, 1)]), ([], [])]
    rows = [tuple([tuple(map(float, x)) for x in side] for side in r) for r in rows]
    got = [r.v for r in spark.createDataFrame(rows, kind).select(book.violations().alias("v")).collect()]
    assert got == [0, 1, 1, 1, 0]


def test_short_book(spark):
    b = spark.createDataFrame([([(10.0, 2.0)], [(11.0, 1.0)])], "bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>")
    r = b.select(book.imbalance(3).alias("i3"), book.imbalance(1).alias("i1"), book.microprice(5).alias("m"), *book.flatten()).first()
    assert r.i3 == 0.0 and r.i1 == pytest.approx(1 / 3) and r.m == pytest.approx((2 * 11 + 1 * 10) / 3) and r.bid_price_2 is None


def test_full_windows(spark):
    rows = series(spark, [1, 2, 3, 4]).select("ts", Rolling().mean("close", 3).alias("m"), Rolling().weighted("close", 2).alias("w")).orderBy("ts").collect()
    assert [r.m for r in rows] == [None, None, 2.0, 3.0]
    assert rows[1].w == pytest.approx(5 / 3)


def test_ema_by_hand():
    got = scan.ema(pd.Series([1.0, 2, 3, 4, 5, 6]), 3)
    assert got.isna().tolist() == [True, True, False, False, False, False] and got[2:].tolist() == [2, 3, 4, 5]


def test_wilder_seed():
    f = pd.DataFrame({"high": [2.0, 3, 4, 5], "low": [1.0, 2, 3, 4], "close": [1.5, 2.5, 3.5, 4.5]})
    tr = scan.true_range(f)
    assert tr.tolist() == [1.0, 1.5, 1.5, 1.5]
    assert scan.wilder(tr, 2)[1:].tolist() == [1.25, 1.375, 1.4375]


def test_rsi_without_losses():
    assert scan.rsi(pd.Series(np.arange(20.0)), 14).dropna().unique().tolist() == [100.0]


def test_chunks_agree_with_one_pass(spark):
    rng = np.random.default_rng(1)
    bars = series(spark, 100 + np.cumsum(rng.normal(size=900)), step=dt.timedelta(minutes=1))
    cols = ["ema_21", "rsi_14", "atr_14", "macd", "kama_20", "adx", "tema_8"]
    a = scan.recurrences(bars, cols).orderBy("ts").toPandas()
    b = scan.recurrences(bars, cols, chunk=400, overlap=395).orderBy("ts").toPandas()
    for c in cols:
        np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=1e-6, equal_nan=True)


def test_profile_ties():
    h, low, v = np.array([1.0, 3.0, 4.0]), np.array([0.0, 2.0, 3.0]), np.array([10.0, 10.0, 1.0])
    poc, vah, val, held = structure.profile(h, low, h, v, bins=4)
    assert held == pytest.approx(21) and val <= poc <= vah
    assert structure.profile(np.ones(3), np.ones(3), np.ones(3), v)[:1] == (1.0,)


def test_sweep_needs_the_window_before(spark):
    rows = [(f"x", T0 + dt.timedelta(hours=k), 10.0, 10.0, 9.0, 9.5, 1.0) for k in range(14)]
    rows.append(("x", T0 + dt.timedelta(hours=14), 10.0, 10.2, 9.8, 9.9, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    last = lambda d: d.orderBy(F.desc("ts")).first()
    assert last(structure.liquidity(bars)).sweep_high == 1
    assert last(structure.liquidity(bars, include_current=True)).sweep_high == 0


def test_asof_variants_agree(spark):
    left = spark.createDataFrame([(T0 + dt.timedelta(hours=h), h) for h in (0, 5, 30, 60)], "ts timestamp_ntz, k int")
    right = spark.createDataFrame([(T0 + dt.timedelta(hours=h), float(h)) for h in (1, 5, 29)], "ts timestamp_ntz, v double")
    want = [(0, None), (5, 5.0), (30, 29.0), (60, 29.0)]
    for extra in ({}, {"bucket": "1 day"}):
        assert sorted((r.k, r.v) for r in align.asof(left, right, ["v"], **extra).collect()) == want
    near = align.asof(left, right, ["v"], tolerance="2 hours")
    assert sorted((r.k, r.v) for r in near.collect()) == [(0, None), (5, 5.0), (30, 29.0), (60, None)]


def test_anomaly_needs_ten_rows(spark):
    t = ticks(spark, [(k, 100.0 + k % 2, 1.0) for k in range(5)] + [(5, 500.0, 1.0)] + [(k, 100.0 + k % 2, 1.0) for k in range(6, 40)] + [(40, 500.0, 1.0)])
    flagged = [r.sequence for r in t.withColumn("a", validate.price_anomaly()).filter("a").collect()]
    assert flagged == [40]


def test_rules_can_be_removed(spark):
    rules = validate.RuleSet.ticks()
    rules.remove("price_range")
    got = {r.rule: r.passed for r in rules.run(ticks(spark, [(0, 5.0, 2000.0), (1, 5.0, 1.0)])).collect()}
    assert "price_range" not in got and got["volume_range"] is False and got["spread_range"] is True


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.4), (3, 0, 0.6), (4, 0, 0.1)], "id int, y int, p double")
    m = models.classification_metrics(models.with_confidence(df)).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)
    assert models.roc_auc(df).first()[0] == 0.75
    r = spark.createDataFrame([(1, 0.02), (2, 0.01)], "id int, ret double")
    p = models.performance(r, "id").first()
    assert p.sortino == float("inf") and p.max_drawdown == 0.0 and p.profit_factor == 0.0


def test_registry_rejects_cycles():
    e = engine.Engine()
    e.register(engine.Group("a", lambda b: b, after=()))
    e.groups["a"] = engine.Group("a", lambda b: b, after=("b",))
    with pytest.raises(ValueError):
        e.register(engine.Group("b", lambda b: b, after=("a",)))


def test_triple_barrier_tie_goes_down(spark):
    rows = [("x", T0, 10.0, 10.0, 10.0, 10.0, 1.0), ("x", T0 + dt.timedelta(hours=1), 10.0, 12.0, 8.0, 10.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    assert trading.triple_barrier(bars, 1.0, 1.0, 1).orderBy("ts").first().barrier == -1


def test_store_round_trip(spark, tmp_path):
    s = storage.Store(spark, f"file://{tmp_path}/store")
    t = ticks(spark, [(0, 1.0, 1.0), (90_000, 2.0, 1.0)])
    assert s.store(t, "tick") and not s.store(t.limit(0), "tick")
    assert s.read("tick", "2024-01-02", None).count() == 1
    assert s.retrieve("tick").count() == 2
    assert sorted(r.records for r in s.partitions("tick").collect()) == [1, 1]
    s.compact("tick")
    assert s.delete_before("tick", "2024-01-02") == 1 and s.read("tick").count() == 1


def test_narrowing_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 << 40), (2, 3)], "a long, b long")
    assert dict(storage.narrow(df).dtypes) == {"a": "int", "b": "bigint"}
    (tmp_path / "log.json").write_text('{"timestamp": "2024-01-01T00:00:00", "trade_id": "1", "pnl": 2.0}\nnot json\n')
    from lodestream.sources.schemas import TRADE_LOG

    assert storage.read_log(spark, f"file://{tmp_path}/log.json", TRADE_LOG).count() == 1


def test_streamed_bars_equal_batch(spark, tmp_path):
    t = ticks(spark, [(k * 7, 100.0 + k % 5, 1.0) for k in range(60)])
    t.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = live.file_ticks(spark, str(tmp_path / "in"), t.schema.simpleString()[7:-1].replace(":", " "), 1)
    q = live.stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts.replace(tzinfo=None), r.open, r.close, r.ticks) for r in spark.table("bars").collect()}
    assert got == {(r.ts, r.open, r.close, r.ticks) for r in resample.ohlcv(t, "1 minute").collect()}
    seen = []
    q = live.fan_out(stream, [lambda b, _: seen.append(b.count())], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(seen) == 60


def test_running_state(spark, tmp_path):
    bars = series(spark, [1, 2, 3, 4])
    bars.repartition(1).write.parquet(str(tmp_path / "in"))
    x = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = live.running_indicators(x).writeStream.format("memory").queryName("state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r.ema_20 for r in spark.table("state").orderBy("ts").collect()]
    assert got == pytest.approx(scan.ewm(pd.Series([1.0, 2, 3, 4]), 2 / 21).tolist())
