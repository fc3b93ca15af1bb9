"""Operators that no registered query covers, on small frames worked out by hand or against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions.scalar import business_relevance
from lodestream.operators import align, checks, clean, isolation, models, ordered, reports, resample, scan, structure, trading
from lodestream.plans import engine, settings
from lodestream.sources.storage import Store
from lodestream.streaming import live

T0 = dt.datetime(2024, 1, 1)


def bars(spark, n=60, symbols=("a", "b"), seed=1):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        p = 100.0
        for k in range(n):
            o, p = p, p + rng.uniform(-1, 1)
            rows.append((s, T0 + dt.timedelta(hours=k), o, max(o, p) + rng.random(), min(o, p) - rng.random(), p, rng.uniform(1, 9)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_running_sums_and_maxima(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("xy"), rng.randint(0, 30), rng.randint(-5, 9)) for k in range(300)] + [(1000, None, 3, 4), (1001, "x", None, 2)]
    df = spark.createDataFrame(rows, "id long, g string, at int, v int")
    got = {r.id: (r.total, r.most) for r in ordered.running(df, ["at", "id"], {"total": "v"}, {"most": "v"}, by=["g"]).collect()}
    for i, g, at, v in rows:
        before = [x for x in rows if x[1] == g and (-1 if x[2] is None else x[2], x[0]) <= (-1 if at is None else at, i)]
        assert got[i] == (sum(x[3] for x in before), max(x[3] for x in before))
    down = {r.id: r.total for r in ordered.running(df, ["id"], {"total": "v"}, descending=True).collect()}
    assert down[298] == sum(v for i, _, _, v in rows if i >= 298)
    assert ordered.running(df.limit(0), ["at"], {"total": "v"}).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), float(rng.randint(0, 12)) if rng.random() < 0.9 else None) for _ in range(400)] + [("one", 7.0), ("none", None)]
    got = {r.g: list(r.q) for r in ordered.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.25, 0.5, 0.99, 1.0], ["g"], "q").collect()}
    for g in "xyz":
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], [0.0, 0.25, 0.5, 0.99, 1.0]))
    assert got["one"] == [7.0] * 5 and "none" not in got


@pytest.mark.parametrize("bucket", ["1 hour", "1 day", "4 weeks"])
def test_carried_values(spark, bucket):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), T0 + dt.timedelta(minutes=37 * k), float(k) if rng.random() < 0.3 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, v double")
    for back in (False, True):
        got = {r.ts: r.v for r in ordered.carry(df, ["v"], by=["g"], back=back, bucket=bucket).collect()}
        for g in ("x", "y", None):
            last = None
            for h, t, v in reversed(rows) if back else rows:
                if h == g:
                    last = last if v is None else v
                    assert got[t] == last


def test_asof_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([("x", T0, 1), (None, T0, 2)], "g string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("x", T0 - dt.timedelta(days=9), 5.0)], "g string, ts timestamp_ntz, q double")
    assert {r.id: r.q for r in align.asof(left, right, ["q"], by=["g"]).collect()} == {1: 5.0, 2: None}


def test_fills_stay_with_their_symbol(spark):
    orders = spark.createDataFrame([("a", T0, 1, "buy"), ("b", T0, 2, "buy")], "symbol string, ts timestamp_ntz, order_id long, side string")
    quotes = spark.createDataFrame([("a", T0 - dt.timedelta(hours=2), 1.0, 2.0), ("b", T0 - dt.timedelta(hours=1), 7.0, 8.0)], "symbol string, ts timestamp_ntz, bid double, ask double")
    assert {r.symbol: r.ask for r in trading.simulate_fills(orders, quotes).collect()} == {"a": 2.0, "b": 8.0}


def test_bars_of_odd_lengths_come_from_ticks(spark):
    rows = [("s", T0 + dt.timedelta(seconds=k), float(k % 17), 1.0, "buy", k) for k in range(400)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, volume double, side string, sequence long")
    freqs = ["7 seconds", "10 seconds", "20 seconds", "1 minute"]
    got = resample.multi_frequency(ticks, freqs)
    for f in freqs:
        want = sorted(map(tuple, resample.derived(resample.ohlcv(ticks, f)).collect()))
        assert sorted(map(tuple, got.filter(F.col("freq") == f).drop("freq").collect())) == want


def test_checks_of_columns_and_frames(spark):
    df = spark.createDataFrame([("s", T0, 1.0, 5.0, float(k), 2.0 * k, float(k)) for k in range(120)], "symbol string, ts timestamp_ntz, price double, volume double, a double, b double, c double")
    rows = {r["column"]: r for r in checks.column_checks(df, ["price", "a"]).collect()}
    assert rows["price"].constant and not rows["a"].constant
    assert checks.repeated_columns(df, ["a", "b", "c"]) == [("a", "c")]
    assert checks.frame_is_valid(df, "tick") == (True, [])
    assert checks.frame_is_valid(df, "bars")[0] is False and checks.missing_columns(df, "bars") == ["open", "high", "low", "close"]
    assert checks.frame_is_valid(df.limit(0), "tick") == (False, ["empty"])
    assert checks.frame_is_valid(df.withColumn("price", F.lit(float("inf"))), "tick")[0] is False
    assert checks.frame_is_valid(df.limit(5), "tick") == (True, ["5 rows"])


def test_times_samples_and_batches(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02T03:04:05",), ("2024-01-02",), ("02/01/2024 03:04",), ("no",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(checks.parse_time(F.col("t"))).collect()]
    assert got == ["2024-01-02 03:04:05"] * 2 + ["2024-01-02 00:00:00", "2024-01-02 03:04:00", "None", "None"]
    ids = spark.range(10_000)
    one, again = ({r.id for r in checks.sample(x, 0.1, "id").collect()} for x in (ids, ids.repartition(7)))
    assert one == again and 800 < len(one) < 1200
    sizes = [r.n for r in checks.map_batches(spark.range(0, 25, 1, 1), lambda f: f.assign(n=len(f))[["n"]], "n long", 10).collect()]
    assert sorted(sizes) == [5] * 5 + [10] * 20


def test_isolation_forest_finds_what_lies_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(k, *rng.normal(size=3).tolist()) for k in range(300)] + [(1000 + k, *(9 + rng.normal(size=3)).tolist()) for k in range(3)] + [(2000, None, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: (r.isolation, r.anomaly) for r in isolation.isolation_forest(df, ["a", "b", "c"], share=0.05).collect()}
    assert len(got) == len(rows) and all(got[1000 + k][1] for k in range(3)) and not got[2000][1]
    assert min(got[1000 + k][0] for k in range(3)) > sorted(got[k][0] for k in range(300))[290]
    assert not any(r.anomaly for r in isolation.isolation_forest(df.limit(20), ["a"]).collect())
    tree = isolation.Tree(np.arange(8.0)[:, None], np.random.default_rng(1))
    assert len(tree.depths(np.arange(8.0)[:, None])) == 8 and isolation.mean_depth(1) == 0


def test_models_are_kept_and_scored_by_folds(spark, tmp_path):
    rng = random.Random(7)
    df = spark.createDataFrame([(k, x := rng.random(), int(x > 0.5)) for k in range(240)], "id long, x double, y int")
    trees = models.BoostedTrees(rounds=2, depth=2)
    out, losses = models.cross_validate(df, ["x"], "y", ["id"], 2, trees)
    assert out.count() == 240 and len(losses) == 2 and all(0 < v < 1 for v in losses)
    assert out.filter("fold = 0 and oof <> 0").count() == 0
    model = trees.fit(df, ["x"], "y")
    mark = models.save_model(model, f"file://{tmp_path}/m", ["x"])
    again, note = models.load_model(f"file://{tmp_path}/m")
    assert note["hash"] == mark and note["features"] == ["x"]
    p = lambda m: sorted(r.p for r in models.predict(m, df).collect())
    assert p(model) == p(again)
    scores = spark.createDataFrame([("a", 0.1), ("b", -0.9), ("c", 0.5)], "feature string, score double")
    assert [r.feature for r in models.top_features(scores, 2).collect()] == ["b", "c"] and models.prune_features(scores, 0.1) == ["c", "a"]
    importance = {r.feature: r.importance for r in models.permutation_importance(df.withColumn("z", F.lit(0.5) + F.col("id") % 7), ["x", "z"], "y").collect()}
    assert importance["x"] > 0.5 > 0.1 > importance["z"]


def test_bootstrap_of_a_mean(spark):
    df = spark.createDataFrame([(k, float(k % 10)) for k in range(2000)], "id long, ret double")
    got = [r["mean"] for r in trading.bootstrap(df, 300).collect()]
    assert len(got) == 300 and abs(np.mean(got) - 4.5) < 0.02 and 0.04 < np.std(got) < 0.09
    assert sorted(got) == pytest.approx(sorted(r["mean"] for r in trading.bootstrap(df.repartition(5), 300).collect()))


def test_post_processing(spark):
    df = spark.createDataFrame([("s", 1, None, 3.0, 1.0), ("s", 2, 2.0, 3.0, None), ("s", 3, None, 3.0, 5.0), ("s", 3, None, 3.0, 5.0)], "symbol string, ts int, a double, k double, b double")
    got = engine.post_process(df, ["a", "k", "b"]).orderBy("ts")
    assert got.columns == ["symbol", "ts", "b"]  # a and k have one value
    assert [r.b for r in got.collect()] == [1.0, 1.0, 5.0]
    assert engine.drop_constant(df, ["k", "b"]) == ["b"]


def test_settings_documents(tmp_path):
    s = settings.Settings().update({"risk": {"per_trade": 0.01}})
    s.export(str(tmp_path / "s.json"))
    assert settings.Settings.load(str(tmp_path / "s.json")).get("risk.per_trade") == 0.01
    (tmp_path / "e.json").write_text('{"cleaning": {"price_z": ${Z:4}}}')
    assert settings.Settings.load(str(tmp_path / "e.json"), {}).get("cleaning.price_z") == 4
    (tmp_path / "w.json").write_text('{"features": {"value_area": 7}}')
    with pytest.raises(ValueError, match="value_area"):
        settings.Settings.load(str(tmp_path / "w.json"))
    assert settings.substitute("${A}-${B:x}", {"A": "1"}) == "1-x" and settings.substitute("${C}", {}) == "${C}"


def test_buffers_compaction_and_recent_features(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    x = bars(spark, 30, ("a",))
    store.dump_buffers({"bars": x})
    assert store.restore_buffers(["bars"])["bars"].count() == 30
    f = x.select("symbol", "ts", F.lit("minimal").alias("feature_set"), "close")
    assert store.write(f.repartition(4), "features") and not store.write(f.limit(0), "features")
    assert store.recent_features("minimal", 120).count() == 3 and store.recent_features("other", 120).count() == 0
    before = sorted(map(tuple, store.read("features").collect()))
    store.compact("features")
    assert sorted(map(tuple, store.read("features").collect())) == before
    assert [r.files for r in store.partitions("features").collect()] == [1, 1]


def test_streams_of_sessions_quotes_and_news(spark, tmp_path):
    rows = [("s", T0 + dt.timedelta(minutes=m), float(m), 1.0, m) for m in (0, 1, 2, 30, 31, 90)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, sequence long").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    ticks = live.file_ticks(spark, f"file://{tmp_path}/in", "symbol string, ts timestamp, price double, volume double, sequence long")
    for name, df, mode in (("quotes", live.latest_quotes(ticks), "complete"), ("activity", live.activity_sessions(ticks), "complete"), ("news", live.dedup_news(ticks, ["symbol"]), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert live.progress(q)["rows"] == 6
    assert [(r.price, r.symbol) for r in spark.table("quotes").collect()] == [(90.0, "s")]
    assert sorted(r.ticks for r in spark.table("activity").collect()) == [1, 2, 3]
    assert spark.table("news").count() == 1


def test_recurrences_on_demand(spark):
    x = bars(spark, 80, ("a",))
    some = scan.recurrences(x, ["sar", "garch_variance"]).orderBy("ts").collect()
    every = scan.recurrences(x).orderBy("ts").collect()
    assert [(r.sar, r.garch_variance) for r in some] == [(r.sar, r.garch_variance) for r in every]
    with pytest.raises(ValueError):
        scan.recurrences(x, ["sar"], chunk=10, overlap=20)
    closes = [r.close for r in x.orderBy("ts").collect()]
    h, want = None, [None]
    for a, b in zip(closes, closes[1:], strict=False):
        r2 = math.log(b / a) ** 2
        h = r2 if h is None else 2e-6 + 0.09 * r2 + 0.9 * h
        want.append(h)
    assert [r.garch_variance for r in some][1:] == pytest.approx(want[1:])


def test_small_expressions(spark):
    one = spark.range(1)
    row = one.select(*[c.alias(n) for n, c in structure.poc_distance(F.lit(100.0), F.lit(99.99)).items()], trading.kelly(F.lit(0.6), F.lit(2.0), F.lit(1.0)).alias("kelly"), business_relevance(F.lit("obi_5")).alias("r")).first()
    assert row.kelly == pytest.approx(0.02) and row.r == 1.0 and row.near_poc_2 == 1
    df = spark.createDataFrame([(0.2, 0.6)], "a double, b double")
    assert df.select(models.stacked(["a", "b"], [0.75, 0.25])).first()[0] == pytest.approx(0.3)
    log = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), 10.0 * m, 1.0, float(m)) for m in range(5)], "timestamp timestamp, cpu_percent double, memory_mb double, latency_ms double")
    r = reports.monitor_averages(log, 2).first()
    assert (r.samples, r.cpu_percent, r.max_latency_ms) == (3, 30.0, 4.0)
    gaps = spark.createDataFrame([("s", T0 + dt.timedelta(hours=k), v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])], "symbol string, ts timestamp_ntz, v double")
    assert [r[0] for r in gaps.select(clean.interpolate(gaps, "v"), "ts").orderBy("ts").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]
