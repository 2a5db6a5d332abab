"""Nothing is lost to a cap, a prefix or a null: one test for each place where that could happen."""
import datetime as dt
import json

from pyspark.sql import functions as F

from marketlens.functions import normalize as N
from marketlens.functions import rounds as R
from marketlens.operators import features as X
from marketlens.operators import ordered as O
from marketlens.operators import perf as P
from marketlens.operators import wallets as W
from marketlens.plans.leaderboard import build_leaderboard
from marketlens.sources import readers, sinks

T0 = dt.datetime(2026, 1, 1)


def test_rows_without_id_stay_apart(spark, tmp_path):
    rows = [{"proxyWallet": "0xa", "conditionId": "c" * 40, "type": "TRADE", "side": "BUY", "outcome": "Up", "size": s, "usdcSize": s, "timestamp": 1700000000 + s, "title": "t"} for s in (1, 2, 3)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows + rows[:1])))
    assert readers.read_activity(spark, str(tmp_path / "a.json")).count() == 3


def test_velocity_looks_past_many_ticks(spark):
    rows = [("BTC", T0 + dt.timedelta(seconds=i / 2), 100.0 + i) for i in range(400)]
    got = X.price_velocity(spark.createDataFrame(rows, "asset string, ts timestamp, price double"))
    assert got.filter("velocity <> 0").count() == 400 - 120
    assert {r[0] for r in got.filter("velocity <> 0").select("velocity").collect()} == {120.0}


def test_all_book_levels_count(spark):
    msg = {"asset": "a", "ts": 1, "bids": [[str(i / 100), "1"] for i in range(1, 41)], "asks": [["0.9", "1"]]}
    got = readers.parse_books(spark.createDataFrame([(json.dumps(msg),)], "value string")).first()
    assert got["best_bid"] == 0.40 and len(got["bids"]) == 40


def test_prior_counts_every_outcome(spark):
    rows = [("k", i, i % 2 == 0, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, won boolean, pnl double")
    assert P.sample_prior(df, ["k"], ["t"]).first()["n"] == 500
    assert P.sample_prior(df, ["k"], ["t"], keep=10).first()["n"] == 10


def test_long_ids_and_questions_do_not_merge(spark):
    df = spark.createDataFrame([("0123456789abc", "q" * 70 + "a"), ("0123456789abd", "q" * 70 + "b")], "cid string, q string")
    k = R.round_key(F.lit("btc"), F.lit(15), F.lit(0.0), F.lit(0.0), "cid")
    f = R.round_fingerprint(F.lit("btc"), F.lit(15), F.lit(0.0), F.lit(0.0), "q")
    assert df.select(k).distinct().count() == 2 and df.select(f).distinct().count() == 2


def test_zone_offsets_count(spark):
    texts = ["2026-02-21T08:45:00-05:00", "2026-02-21T08:45:00Z", "2026-02-21T08:45:00.123+0130", "2026-02-21 08:45:00", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.parse_iso("t").cast("string")).collect()]
    assert got == ["2026-02-21 13:45:00", "2026-02-21 08:45:00", "2026-02-21 07:15:00", "2026-02-21 08:45:00", None, None]


def test_fifteen_minute_titles(spark):
    a, m = N.classify_family(F.lit(None).cast("string"), F.col("t"))
    got = spark.createDataFrame([("Bitcoin 15m",), ("Bitcoin 5m",)], "t string").select(m).collect()
    assert [r[0] for r in got] == [15, 5]


def test_null_keys_and_times_stay(spark):
    rows = [("a", T0, 1.0, "WIN"), (None, T0, -2.0, "LOSS"), ("a", None, 3.0, "WIN")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, pnl double, result string").withColumn("won", F.col("pnl") > 0)
    eq = {(r["k"], r["ts"]): r["equity"] for r in P.equity_curve(df, ["k"], ["ts"]).collect()}
    assert eq == {("a", None): 3.0, ("a", T0): 4.0, (None, T0): -2.0}  # rows without a time come first
    assert P.PriorFrame(df, ["k"], ["ts"]).with_columns(x=F.lit(1)).count() == 3
    assert P.loss_streak_rows(df, ["k"], ["ts"]).count() == 3
    assert {r["k"] for r in P.pnl_summary(df, ["k"], ["ts"]).collect()} == {"a", None}
    run = O.running(O.add_chunk(df, "ts", 60), ["k"], ["ts"], {"s": ("sum", F.col("pnl"))})
    assert sorted(r["s"] for r in run.collect()) == [-2.0, 3.0, 4.0]
    assert O.time_halo(df, "ts", 60, 10).count() == 3


def test_balanced_chunks_split_a_hot_key(spark):
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.timestamp_millis(F.col("id")).alias("ts"), F.lit(1.0).alias("pnl"))
    d = O.balanced_chunks(df, ["k"], ["ts"])
    assert d.groupBy(O.CHUNK).count().agg(F.max("count")).first()[0] < n / 3  # 90 % of the rows share a key and a day
    got = P.equity_curve(df, ["k"], ["ts"], width_s=None).groupBy("k").agg(F.max("equity").alias("e"), F.count("*").alias("n")).collect()
    assert {r["k"]: (r["e"], r["n"]) for r in got} == {"a": (18_000.0, 18_000), "b": (2_000.0, 2_000)}
    idx = O.dense_index(df, ["k"], ["ts"], ts="ts", width_s=None)
    assert idx.groupBy("k").agg(F.max(O.INDEX), F.countDistinct(O.INDEX)).filter("k = 'a'").first()[1:] == (17_999, 18_000)


def test_leader_flow_covers_own_markets_only(spark):
    trades = [("m1", 1, "BUY", "Up", 0.5, 10.0, 1), ("m1", 2, "BUY", "Up", 0.5, 10.0, 2), ("m2", 2, "BUY", "Down", 0.5, 10.0, 3), ("m1", 3, "BUY", "Down", 0.5, 10.0, 4)]
    t = spark.createDataFrame(trades, "condition_id string, wallet long, side string, outcome string, price double, size double, n int").withColumn("ts", F.timestamp_seconds("n"))
    acts = [(w, f"s{i}", k, 10.0, 20.0) for w in (2, 3) for i in range(9) for k in ("BUY", "REDEEM")]
    a = spark.createDataFrame(acts, "wallet long, condition_id string, type string, usdc_size double, size double").withColumn("ts", F.timestamp_seconds(F.lit(10)))
    lead, flow = build_leaderboard(t, a.withColumns({"side": F.lit("BUY"), "outcome": F.lit("Up"), "title": F.lit("")}), 1, 1e6)
    assert lead.count() == 2
    assert [r["condition_id"] for r in flow.collect()] == ["m1"]


def test_metrics_follow_file_order(spark, tmp_path):
    (tmp_path / "2026-01-01.jsonl").write_text(json.dumps({"event": "ENTRY", "condition_id": "c", "score": 1}) + "\n")
    (tmp_path / "2026-01-02.jsonl").write_text("".join(json.dumps({"event": "ENTRY", "condition_id": f"c{i}", "score": 2, "pad": "x" * 90}) + "\n" for i in range(50)))
    got = readers.read_metrics(spark, str(tmp_path)).orderBy("seq").select(F.col("seq.file").alias("f")).collect()
    assert got[0]["f"].endswith("2026-01-01.jsonl") and len(got) == 51


def test_upsert_keeps_first_write_and_raises_other_errors(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda p: spark.createDataFrame([("BTC", 1_700_000_000, "Up", p)], "asset string, round_ts long, side string, p double")
    sinks.upsert_hist_calib(row(0.1), path)
    sinks.upsert_hist_calib(row(0.2), path)
    assert [r["p"] for r in spark.read.parquet(path).collect()] == [0.1]


def test_peer_order_is_a_parameter(spark):
    t = spark.createDataFrame([("m", 1, "BUY", "Up", 1, 2), ("m", 1, "BUY", "Down", 1, 1)], "condition_id string, wallet long, side string, outcome string, ts long, n int")
    assert W.own_sides(t, 1, ("ts", "n")).first()["own_side"] == "Up"


def test_defaults_split_a_hot_key_of_one_day(spark, monkeypatch):
    """90 % of the rows in one key and one day: no chunk of any ordered operator holds much more than its share."""
    from marketlens.operators import asof, features, perf, positions, smoothing

    real, shares = O.balanced_chunks, []

    def measured(df, keys, order, name=O.CHUNK):
        out = real(df, keys, order, name)
        n = [r["count"] for r in out.groupBy(name).count().collect()]
        shares.append(max(n) / sum(n))
        return out

    for m in (O, perf, asof):
        monkeypatch.setattr(m, "balanced_chunks", measured)
    df = spark.range(0, 20000, 1, 8).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("asset"), F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 4_000_000).alias("ts"),
        (F.col("id") % 13 - 6.0).alias("pnl"), (F.col("id") % 3 == 0).alias("won"), (F.col("id") % 50 + 100.0).alias("c"), F.col("id").alias("i"))
    key, order = ["asset"], ["ts"]
    runs = [perf.equity_curve(df, key, order), perf.max_drawdown(df, key, order), perf.loss_streak_rows(df, key, order), perf.drawdown_scales(df, key, order, start=100.0),
            smoothing.row_ema(df, 0.5, keys=key, order=order, value="pnl"), features.BarFrame(df.select("asset", "ts", "c"), n=14).df,
            positions.retry_cooldown(df, key, order) if positions.retry_cooldown.__code__.co_argcount == 3 else df,
            asof.asof_backward(df, df, key, left_ts="ts", right_ts="ts", take={"x": "i"}, width_s=None), asof.asof_many(df, [asof.Source(df, "ts", {"x": "i"})], key, left_ts="ts"),
            perf.variant_switch(df.withColumn("best", F.when(F.col("won"), "a").otherwise("b")), key, order)]
    assert all(x.count() for x in runs) and len(shares) >= 9 and max(shares) < 0.35
