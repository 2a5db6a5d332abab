import json

import pytest
from pyspark.sql import functions as F

from marketlens.sources import readers as R
from marketlens.sources import sinks as K


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_activity_dedupe_and_bad_line(spark, tmp_path):
    p = put(tmp_path / "a.json", {"id": "1", "proxyWallet": " 0xAB ", "conditionId": "c", "type": "TRADE", "timestamp": 1700000000000}, {"id": "1", "conditionId": "c"},
            {"transactionHash": "t", "timestamp": 1700000000}, {"transactionHash": "t"}, "{broken", {"title": "x"}, {"title": "x"})
    r = R.read_activity(spark, p).collect()
    assert len(r) == 3 and {x.wallet for x in r} == {"0xab", None}


def test_rounds(spark, tmp_path):
    good = {"conditionId": "c1", "slug": "btc-updown-5m-1", "question": "q", "endDate": "2026-02-21T08:45:00Z", "eventStartTime": "2026-02-21T08:30:00Z", "outcomes": '["Up","Down"]', "outcomePrices": '["0.99","0.01"]', "clobTokenIds": '["1","2"]', "closed": True}
    p = put(tmp_path / "e.json", {"id": "e", "seriesSlug": "btc-up-or-down-15m", "markets": [good, {**good, "conditionId": "c2", "outcomePrices": '["x","0.01"]'}, {**good, "conditionId": "c3", "outcomePrices": '["0.5","0.5"]'}]}, "nope")
    r = R.read_rounds(spark, p)
    assert sorted(x.condition_id for x in r.collect()) == ["c1", "c3"]
    w = R.resolved_rounds(r).collect()
    assert [(x.condition_id, x.winner, x.asset, x.duration, x.tokens) for x in w] == [("c1", "Up", "BTC", 15, ["1", "2"])]


def test_klines_last_line_wins(spark, tmp_path):
    k = lambda c: [1700000000000, "1", "3", "0.5", c, "10", 0, 0, 0, "4"]
    p = put(tmp_path / "k.json", {"asset": "BTC", "interval": "5m", "seq": 1, "rows": [k("2"), ["bad"]]}, {"asset": "BTC", "interval": "5m", "seq": 2, "rows": [k("2.5")]})
    r = R.read_klines(spark, p).collect()
    assert [(x.o, x.h, x.l, x.c, x.v, x.taker_v) for x in r] == [(1.0, 3.0, .5, 2.5, 10.0, 4.0)]


def test_metrics_keep_present_keys(spark, tmp_path):
    p = put(tmp_path / "m.jsonl", {"event": "ENTRY", "condition_id": "a", "score": 5}, {"event": "RESOLVE", "condition_id": "a", "score": None, "pnl": 1.5}, "oops", "")
    r = {x.event: x for x in R.read_metrics(spark, p).collect()}
    assert r["ENTRY"].score == 5 and "score" in r["RESOLVE"].present and r["RESOLVE"].score is None and len(r) == 2


def test_result_log_and_ledger(spark, tmp_path):
    p = put(tmp_path / "log.txt", "\x1b[92m[WIN]\x1b[0m BTC Up 15m | \x1b[92m$+1.23\x1b[0m | Bank $10", "[LOSS] ETH | $-2.50 | Bank $7", "[INFO] nothing")
    assert sorted((x.result, x.pnl) for x in R.read_result_log(spark, p).collect()) == [("LOSS", -2.5), ("WIN", 1.23)]
    row = {c: "" for c in K.LEDGER_COLUMNS}
    df = spark.createDataFrame([{**row, "result": "win", "pnl": "+1.5"}, {**row, "result": "LOSS", "pnl": "??"}, {**row, "result": "PLACED", "pnl": "0"}])
    K.write_ledger(df, str(tmp_path / "ledger"))
    assert sorted((x.result, x.pnl) for x in R.read_ledger(spark, str(tmp_path / "ledger")).collect()) == [("LOSS", 0.0), ("WIN", 1.5)]


def test_flow_pending_prices_probes(spark, tmp_path):
    doc = {"generated_at": 1700000000, "wallet": "w", "leaders": [{"wallet": "A", "score": 0.5}, {"wallet": "B", "score": 0}], "market_side_flow": {"c1": {"Up": .25, "Down": .75, "n": 9}}}
    lead, flow = R.read_flow_snapshot(spark, put(tmp_path / "flow.json", json.dumps(doc, indent=1)))
    assert [x.wallet for x in lead.collect()] == ["a"] and [(x.condition_id, x.up, x.n) for x in flow.collect()] == [("c1", .25, 9)]
    pend = {"c1": [{"question": "q", "asset": "BTC", "end_ts": 1000.0}, {"side": "Up", "size": 2.0, "entry": .5}], "old": [{"end_ts": 10.0}, {"side": "Up"}]}
    assert [(x.condition_id, x.side, x.asset) for x in R.read_pending(spark, put(tmp_path / "pending.json", json.dumps(pend)), 900.0).collect()] == [("c1", "Up", "BTC")]
    tp = R.read_token_prices(spark, put(tmp_path / "tp.json", {"token_id": "1", "history": [{"t": 5, "p": .4}, {"t": None, "p": .4}]})).collect()
    assert len(tp) == 1 and tp[0].price == .4
    assert R.read_probe_log(spark, put(tmp_path / "probe.json", {"endpoint": "book", "latency_ms": 12.5}, "x")).count() == 1


def test_messages(spark):
    msg = lambda *x: spark.createDataFrame([(json.dumps(m),) for m in x], "value string")
    t = R.parse_ticks(msg({"topic": "crypto_prices", "ts": 1700000000, "payload": {"symbol": "BTCUSDT", "value": 5.0}}, {"topic": "crypto_prices", "ts": 1, "payload": {"symbol": "x", "value": 1}},
                          {"topic": "other", "payload": {"symbol": "btcusdt", "value": 1}}, {"topic": "crypto_prices", "ts": 1, "payload": {"symbol": "btcusdt", "value": 0}})).collect()
    assert [(x.asset, x.price) for x in t] == [("BTC", 5.0)]
    b = R.parse_books(msg({"asset": "T", "ts": 1, "bids": [], "asks": [["0.62", "5"], ["0.60", "1"]]})).first()
    assert b.best_ask == .6 and round(b.best_bid, 6) == .5
    o = R.parse_oracle(msg({"asset": "BTC", "round_id": 18446744073709562777, "answer": 6500000000000, "updated_at": 1700000000})).first()
    assert o.price == 65000.0 and int(o.round_id) == 18446744073709562777
    assert R.parse_perp(msg({"asset": "BTC", "ts": 1, "mark": "10.5", "index": "10", "funding": "x"})).first().funding == 0.0


def test_insert_or_ignore(spark, tmp_path):
    path = str(tmp_path / "hist")
    mk = lambda *r: spark.createDataFrame(r, "asset string, round_ts long, side string, won long, llr double, true_prob double")
    K.upsert_hist_calib(mk(("BTC", 1, "Up", 1, .1, .5), ("BTC", 1, "Up", 0, .2, .6)), path)
    K.upsert_hist_calib(mk(("BTC", 1, "Up", 0, 9.0, .9), ("BTC", 2, "Up", 0, .3, .5)), path)
    r = spark.read.parquet(path).collect()
    assert sorted(x.round_ts for x in r) == [1, 2] and all(x.llr < 9 for x in r)


def test_write_events(spark, tmp_path):
    K.write_events(spark.createDataFrame([("ENTRY", "a"), ("RESOLVE", "a")], "event string, condition_id string"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 2


def _hist(spark, *rows):
    return spark.createDataFrame(rows, "asset string, round_ts long, side string, won long, llr double, true_prob double")


def test_two_writers_leave_each_key_once(spark, tmp_path, monkeypatch):
    """The second writer checks the store, then the first one commits: the second must check again."""
    path, real, calls = str(tmp_path / "hist"), K.publish, []

    def late(rows, *args, **kw):
        if not calls:
            calls.append(1)
            K.upsert_hist_calib(_hist(spark, ("BTC", 1, "Up", 1, .1, .5)), path)
        return real(rows, *args, **kw)

    monkeypatch.setattr(K, "publish", late)
    K.upsert_hist_calib(_hist(spark, ("BTC", 1, "Up", 0, 9.0, .9), ("BTC", 2, "Up", 0, .3, .5)), path)
    for _ in range(2):  # a repeated job
        K.upsert_hist_calib(_hist(spark, ("BTC", 2, "Up", 1, 8.0, .5), ("ETH", 1, "Up", 1, .2, .5)), path)
    got = sorted((x.asset, x.round_ts, x.llr) for x in spark.read.parquet(path).collect())
    assert got == [("BTC", 1, .1), ("BTC", 2, .3), ("ETH", 1, .2)]


def test_a_failed_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "hist")
    K.upsert_hist_calib(_hist(spark, ("BTC", 1, "Up", 1, .1, .5)), path)
    bad = _hist(spark, ("BTC", 3, "Up", 1, .1, .5)).withColumn("llr", F.expr("raise_error('lost')").cast("double"))
    with pytest.raises(Exception, match="lost"):
        K.upsert_hist_calib(bad, path)
    assert spark.read.parquet(path).count() == 1


def test_streaming_sinks_take_a_batch_once(spark, tmp_path):
    """A query that dies behind the write of a batch sends it again after its restart."""
    put(tmp_path / "a.json", {"event": "ENTRY", "condition_id": "c1"}, {"event": "RESOLVE", "condition_id": "c1"})
    (tmp_path / "in").mkdir()
    (tmp_path / "a.json").rename(tmp_path / "in" / "a.json")
    out, folder = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(write):
        src = spark.readStream.schema("event string, condition_id string").json(str(tmp_path / "in"))
        q = src.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()
        q.awaitTermination()

    write = K.event_batches(out)

    def dies(batch, batch_id):
        write(batch, batch_id)
        raise RuntimeError("lost behind the write")

    with pytest.raises(Exception, match="lost behind"):
        run(dies)
    run(write)
    put(tmp_path / "in" / "b.json", {"event": "ENTRY", "condition_id": "c2"})
    run(write)
    got = sorted((x.event, x.condition_id, x.batch) for x in spark.read.json(out).collect())
    assert got == [("ENTRY", "c1", 0), ("ENTRY", "c2", 1), ("RESOLVE", "c1", 0)]
    ledger = spark.createDataFrame([{**{c: "" for c in K.LEDGER_COLUMNS}, "result": "WIN", "pnl": "+1.5"}])
    for _ in range(2):
        K.ledger_batches(str(tmp_path / "ledger"))(ledger, 7)
    assert [x.pnl for x in R.read_ledger(spark, str(tmp_path / "ledger")).collect()] == [1.5]
