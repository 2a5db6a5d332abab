"""Batch = stream, driven by landed files through the memory sink."""
import json
import math

from pyspark.sql import functions as F

from marketlens.operators.smoothing import TAUS
from marketlens.sources.readers import parse_ticks
from marketlens.streaming import streams as S

TICK = "asset string, ts timestamp, price double"


def land(spark, tmp_path, name, rows, schema, files=3):
    """Writes rows in order as several JSON files; returns a stream over them, one file per trigger."""
    d = tmp_path / name
    d.mkdir()
    step = math.ceil(len(rows) / files)
    import os
    for i in range(files):
        p = d / f"{i:03d}.json"
        p.write_text("\n".join(json.dumps(r) for r in rows[i * step:(i + 1) * step]))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def drain(spark, df, name, tmp_path, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", S.checkpoint_root(spark, str(tmp_path)) + f"/{name}").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def ticks(n=120):
    return [{"asset": "BTC" if i % 3 else "ETH", "ts": f"2024-01-01T00:{i // 6:02d}:{i % 6 * 10:02d}Z", "price": 100.0 + (i * 7) % 13} for i in range(n)]


def test_bar_upsert_equals_batch(spark, tmp_path):
    rows = ticks()
    got = drain(spark, S.bars_upsert(land(spark, tmp_path, "t1", rows, TICK)), "bars1", tmp_path, "update")
    last = got.groupBy("asset", "start_ts").agg(F.max_by(F.struct("o", "h", "l", "c", "n"), "n").alias("b")).select("asset", "start_ts", "b.*")
    batch = spark.createDataFrame([(r["asset"], r["ts"], r["price"]) for r in rows], "asset string, t string, price double").withColumn("ts", F.to_timestamp("t"))
    want = S._ohlc(batch.groupBy("asset", F.window("ts", "1 minute"))).drop("end_ts")
    assert sorted(map(tuple, last.collect())) == sorted((r.asset, r.start_ts, r.o, r.h, r.l, r.c, r.n) for r in want.collect())


def test_round_windows_close_on_watermark(spark, tmp_path):
    got = drain(spark, S.round_windows(land(spark, tmp_path, "t2", ticks(), TICK), 5), "rounds5", tmp_path)
    assert {r.start_ts.minute for r in got.collect()} == {0, 5, 10}


def test_ema_stream_equals_loop(spark, tmp_path):
    rows = ticks(60)
    got = {(r.asset, r.price, r.ts): r for r in drain(spark, S.ema_stream(land(spark, tmp_path, "t3", rows, TICK)), "ema1", tmp_path).collect()}
    assert len(got) == 60
    for asset in ("BTC", "ETH"):
        x = last = None
        for r in sorted((k for k in got if k[0] == asset), key=lambda k: k[2]):
            t = r[2].timestamp()
            x = r[1] if x is None else x + (1 - math.exp(-(t - last) / TAUS[-1])) * (r[1] - x)
            last = t
            assert abs(got[r][f"ema_{TAUS[-1]}"] - x) < 1e-9


def test_dedupe_and_late_split(spark, tmp_path):
    rows = ticks(30)
    d = land(spark, tmp_path, "t4", rows + rows, TICK, 2).withColumn("k", F.concat("asset", F.col("ts").cast("string")))
    assert drain(spark, S.dedupe_seen(d, "k"), "dedupe1", tmp_path).count() == 30
    b = spark.createDataFrame([(5.0, 0.0), (100.0, 0.0)], "a double, e double").select(F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("e").alias("e"))
    fresh, late = S.split_late(b, "a", "e", 60)
    assert (fresh.count(), late.count()) == (1, 1)


def test_settlement_queues_once(spark, tmp_path):
    rows = [{"condition_id": f"c{i % 4}", "ts": f"2024-01-01T00:{i:02d}:00Z", "end_ts": f"2024-01-01T00:{5 + (i % 4) * 5:02d}:00Z"} for i in range(40)]
    got = drain(spark, S.settlement_stream(land(spark, tmp_path, "t5", rows, "condition_id string, ts timestamp, end_ts timestamp", 5)), "queue1", tmp_path).collect()
    assert sorted(r.condition_id for r in got) == ["c0", "c1", "c2", "c3"]


def test_position_changes_stream(spark, tmp_path):
    rows = [{"wallet": "w", "ts": f"2024-01-01T00:{i:02d}:00Z", "sig": str(i // 4)} for i in range(12)]
    assert [r.sig for r in drain(spark, S.position_change_stream(land(spark, tmp_path, "t6", rows, "wallet string, ts timestamp, sig string")), "pos1", tmp_path).orderBy("ts").collect()] == ["0", "1", "2"]


def test_entry_resolve_stream(spark, tmp_path):
    e = [{"condition_id": f"c{i}", "ts": f"2024-01-01T00:{i:02d}:00Z", "score": i, "open_price_source": "PM"} for i in range(6)] + [{"condition_id": "z", "ts": "2024-01-01T12:00:00Z", "score": 0, "open_price_source": "PM"}]
    r = [{"condition_id": f"c{i}", "ts": f"2024-01-01T00:{i + 20:02d}:00Z", "pnl": 1.0} for i in range(6)] + [{"condition_id": "z", "ts": "2024-01-01T12:00:00Z", "pnl": 0.0}]
    es = land(spark, tmp_path, "e7", e, "condition_id string, ts timestamp, score int, open_price_source string", 1)
    rs = land(spark, tmp_path, "r7", r, "condition_id string, ts timestamp, pnl double", 1)
    got = drain(spark, S.entry_resolve_stream(es, rs), "er1", tmp_path).where("condition_id <> 'z'").collect()
    assert sorted((x.condition_id, x.score) for x in got) == [(f"c{i}", i) for i in range(6)]


def test_entry_resolve_stream_takes_the_last_entry(spark, tmp_path):
    e = [{"condition_id": "c", "ts": f"2024-01-01T00:{m:02d}:00Z", "score": m, "open_price_source": "PM"} for m in (9, 3, 30, 5)] + [{"condition_id": "z", "ts": "2024-01-01T12:00:00Z", "score": 0, "open_price_source": "PM"}]
    r = [{"condition_id": "c", "ts": "2024-01-01T00:20:00Z", "pnl": 1.0}, {"condition_id": "none", "ts": "2024-01-01T00:21:00Z", "pnl": 2.0}, {"condition_id": "z", "ts": "2024-01-01T12:00:00Z", "pnl": 0.0}]
    es = land(spark, tmp_path, "e8", e, "condition_id string, ts timestamp, score int, open_price_source string", 2)
    rs = land(spark, tmp_path, "r8", r, "condition_id string, ts timestamp, pnl double", 1)
    got = drain(spark, S.entry_resolve_stream(es, rs), "er2", tmp_path).collect()
    assert sorted((x.condition_id, x.score) for x in got if x.condition_id != "z") == [("c", 9), ("none", None)]


def test_kalman_stream_equals_batch(spark, tmp_path):
    from marketlens.operators.smoothing import kalman_velocity
    rows = [r | {"vol": 0.6} for r in ticks(90)]
    got = drain(spark, S.kalman_stream(land(spark, tmp_path, "k1", rows, TICK + ", vol double")), "kalman1", tmp_path).collect()
    d = spark.createDataFrame([(r["asset"], r["ts"], r["price"], r["vol"]) for r in rows], "asset string, t string, price double, vol double").withColumn("ts", F.to_timestamp("t"))
    want = {(r.asset, r.ts): (r.pos, r.vel) for r in kalman_velocity(d).collect()}
    assert len(got) == 90 and all(abs(r.pos - want[r.asset, r.ts][0]) < 1e-9 and abs(r.vel - want[r.asset, r.ts][1]) < 1e-9 for r in got)


def test_leader_flow_accumulates_out_of_order(spark, tmp_path):
    rows = [{"condition_id": f"c{i % 3}", "wallet": f"w{i % 2}", "side": "BUY", "outcome": "Up" if i % 5 else "Down", "ts": f"2024-01-01T00:{(i * 7) % 30:02d}:00Z"} for i in range(60)]
    lead = spark.createDataFrame([("w0", 0.5), ("w1", 0.25)], "wallet string, score double")
    stream = land(spark, tmp_path, "f1", rows, "condition_id string, wallet string, side string, outcome string, ts timestamp", 4)
    got = drain(spark, S.leader_flow_stream(stream, lead, late="1 hour"), "flow1", tmp_path, "update").groupBy("condition_id").agg(F.max_by(F.struct("up", "down", "n"), "n").alias("f")).select("condition_id", "f.*").collect()
    from marketlens.operators import wallets as W
    batch = spark.createDataFrame([(r["condition_id"], r["wallet"], r["side"], r["outcome"]) for r in rows], "condition_id string, wallet string, side string, outcome string")
    assert sorted(map(tuple, got)) == sorted(map(tuple, W.market_side_flow(W.leader_trades(batch, lead)).select("condition_id", "up", "down", "n").collect()))


def test_late_tick_keeps_the_clock(spark, tmp_path):
    rows = [{"asset": "BTC", "ts": f"2024-01-01T00:00:{s:02d}Z", "price": p} for s, p in ((10, 100.0), (5, 50.0), (20, 100.0))]
    got = drain(spark, S.ema_stream(land(spark, tmp_path, "l1", rows, TICK)), "late1", tmp_path).orderBy("ts").collect()
    assert [r.price for r in got] == [50.0, 100.0, 100.0] and got[0][f"ema_{TAUS[0]}"] == 100.0


def test_tick_messages_stream(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "0.txt").write_text(json.dumps({"topic": "crypto_prices", "ts": 1704067200, "payload": {"symbol": "ethusdt", "value": 9.5}}) + "\nnot json\n")
    assert [(r.asset, r.price) for r in drain(spark, parse_ticks(S.text_stream(spark, str(d))), "raw1", tmp_path).collect()] == [("ETH", 9.5)]


def test_sliding_and_latest(spark, tmp_path):
    x = land(spark, tmp_path, "t8", ticks(60), TICK)
    got = drain(spark, S.sliding_moves(x), "slide1", tmp_path, "update").groupBy("asset", "start_ts").agg(F.max_by(F.struct("o", "h", "l", "c", "n", "move"), "n").alias("m")).select("asset", "start_ts", "m.*")
    batch = spark.createDataFrame([(r["asset"], r["ts"], r["price"]) for r in ticks(60)], "asset string, t string, price double").withColumn("ts", F.to_timestamp("t"))
    want = S._ohlc(batch.groupBy("asset", F.window("ts", "60 seconds", "10 seconds"))).withColumn("move", F.col("c") / F.col("o") - 1.0).drop("end_ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    y = land(spark, tmp_path, "t9", ticks(60), TICK).withColumn("condition_id", F.col("asset"))
    n = drain(spark, S.latest_per_market(y, "1 minute"), "latest1", tmp_path).groupBy("condition_id", F.window("ts", "1 minute")).count()
    assert n.where("count > 1").count() == 0


def test_flow_refresh(spark):
    t = spark.createDataFrame([("c", "w", "BUY", "Up", .4)], "condition_id string, wallet string, side string, outcome string, price double")
    seen = []
    S.flow_refresh(lambda df, i: seen.append((i, df.first().up)), spark.createDataFrame([("w", .5)], "wallet string, score double"))(t, 3)
    assert seen == [(3, 1.0)]
