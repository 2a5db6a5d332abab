"""Hand-made frames with known answers for branches the driver tables do not reach."""
import pytest
from pyspark.sql import functions as F

from marketlens.operators import calibration as C
from marketlens.operators import perf as R
from marketlens.operators import positions as P
from marketlens.operators import wallets as W


def test_wallet_without_purchase_is_not_settled(spark):
    a = spark.createDataFrame([("w", "c1", "REDEEM", None, "Up", 5.0, 1.0)], "wallet string, condition_id string, type string, side string, outcome string, usdc_size double, s double")
    r = W.wallet_score(W.wallet_market_fold(a.withColumn("ts", F.timestamp_seconds("s"))), 1e9, lag_s=10, min_bet=1).first()
    assert (r.settled, r.wins, r.wr, r.roi) == (0, 0, 0.0, -1.0)


def test_negative_amounts_are_clipped(spark):
    a = spark.createDataFrame([("w", "c1", "BUY", "BUY", "Up", -5.0, 1.0), ("w", "c1", "BUY", "BUY", "Up", 4.0, 2.0)],
                              "wallet string, condition_id string, type string, side string, outcome string, usdc_size double, s double")
    r = W.wallet_market_fold(a.withColumn("ts", F.timestamp_seconds("s"))).first()
    assert (r.buy, r.last_buy_s) == (4.0, 2.0)


def test_reconcile_gives_every_market_one_action(spark):
    p = spark.createDataFrame([("red", 0.0, 0.0), ("loss", 0.0, 0.0), ("live", 0.0, 0.0), ("stale", 0.0, 0.0), ("fresh", 990.0, 0.0), ("soon", 0.0, 1050.0)], "condition_id string, placed_s double, end_s double")
    v = spark.createDataFrame([("red", "Up", 2.0, True, 4.0), ("loss", "Up", 0.0, True, 4.0), ("live", "Up", 2.0, False, 4.0), ("new", "Up", 2.0, False, 4.0), ("dust", "Up", 0.1, False, 4.0),
                               ("done", "Up", 2.0, False, 4.0), ("win", "Down", 3.0, True, 4.0)], "condition_id string, outcome string, current_value double, redeemable boolean, size double")
    done = spark.createDataFrame([("done",)], "condition_id string")
    got = {r.condition_id: (r.action, r.recovered_entry) for r in P.reconcile_positions(p, v, 1000.0, redeemed=done).collect()}
    assert {k: x[0] for k, x in got.items()} == {"red": "redeem", "loss": "loss", "live": "keep", "stale": "prune", "fresh": "keep", "soon": "keep",
                                                 "new": "recover", "dust": "ignore", "done": "ignore", "win": "queue_redeem"}
    assert got["new"][1] == 0.5


def test_resolve_without_entry_and_null_key(spark):
    e = spark.createDataFrame([("a", 5, 1), ("a", 7, 2)], "condition_id string, score int, seq int")
    r = spark.createDataFrame([("a", None, ["score"]), ("a", None, ["pnl"]), ("b", None, ["pnl"])], "condition_id string, score int, present array<string>")
    got = [x.score for x in R.entry_resolve_join(e, r, ["seq"], present="present").orderBy("condition_id", "present").collect()]
    assert sorted(got, key=str) == [7, None, None]


def test_sortino_without_losses(spark):
    d = spark.createDataFrame([("g", "WIN", 1.0, 100.0, 1), ("g", "WIN", 2.0, 102.0, 2)], "g string, result string, pnl double, bankroll_after double, s long").withColumn("ts", F.timestamp_seconds("s"))
    r = R.pnl_summary(d, ["g"], ["ts"], bank_after="bankroll_after").first()
    assert r.sortino == 99.0 and r.max_dd == 0.0 and r.win_rate == 1.0


def test_empty_frames(spark):
    e = spark.createDataFrame([], "g string, result string, pnl double, won boolean, ts timestamp")
    assert R.pnl_summary(e, ["g"], ["ts"]).count() == 0 and R.loss_streaks(e, ["g"], ["ts"]).count() == 0


def test_paper_resolve_tie_goes_up(spark):
    d = spark.createDataFrame([("Up", 2.0, 2.0), ("Down", 2.0, 2.0)], "side string, open double, close double").withColumns({"size": F.lit(1.0), "entry": F.lit(.5), "mkt_price": F.lit(.5)})
    assert [(r.side, r.result, round(r.pnl, 4)) for r in P.paper_resolve(d).orderBy("side").collect()] == [("Down", "LOSS", -1.0), ("Up", "WIN", 0.9844)]


def test_picks_match_greedy_loop(spark):
    rows = [(t, r, f"c{(t * 7 + r) % 5}", f"f{(t + r) % 3}", "Up" if (t + r) % 2 else "Down", float((t * 5 + r * 3) % 9 + 1)) for t in range(30) for r in range(9)]
    d = spark.createDataFrame(rows, "t int, rank int, condition_id string, fingerprint string, side string, size double")
    got = {(r.t, r["rank"]) for r in P.pick_with_caps(d, ["t"], bankroll=100.0, max_open=4).collect()}
    want = set()
    for t in range(30):
        open_ = []
        for _, rank, cid, fp, side, size in sorted(x for x in rows if x[0] == t):
            tot = lambda f: sum(x[5] for x in open_ if f(x))
            same = lambda j, v: [x for x in open_ if x[j] == v]
            if (len(open_) >= 4 or any(x[4] != side for x in same(2, cid)) or any(x[4] != side for x in same(3, fp))
                    or (same(2, cid) and tot(lambda x: x[2] == cid) + size > 10) or (same(3, fp) and tot(lambda x: x[3] == fp) + size > 10)
                    or tot(lambda x: True) + size > 60 or tot(lambda x: x[4] == side) + size > 40):
                continue
            open_.append((t, rank, cid, fp, side, size))
            want.add((t, rank))
    assert got == want


def test_picks_count_open_positions_and_caps_per_time(spark):
    sig = spark.createDataFrame([(t, r, f"c{r}", f"f{r}", "Up" if r % 2 else "Down", 5.0, 0.5 if t else 0.2) for t in (0, 1) for r in range(6)],
                                "t int, rank int, condition_id string, fingerprint string, side string, size double, cap double")
    held = spark.createDataFrame([(1, "c0", "x", "Up", 10.0), (1, "y", "f1", "Up", 30.0)], "t int, condition_id string, fingerprint string, side string, size double")
    got = sorted((r.t, r["rank"]) for r in P.pick_with_caps(sig, ["t"], bankroll=100.0, max_open=4, total_cap="cap", side_cap=0.45, open_positions=held).collect())
    # t=0: four picks of 5 fill the cap of 20. t=1: two held; c0 is held on the other side, f1 is full, then 40 of 50 is used
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def test_variant_switch_equals_loop(spark):
    import random
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(3)}", i * 40 + rng.randrange(40), rng.choice(["a", "a", "a", "b", "c"])) for i in range(400)]
    d = spark.createDataFrame([*rows, ("r0", None, "b")], "run string, s long, best string").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.run, r.s): r.active for r in R.variant_switch(d, ["run"], ["ts"], hold_s=300, start="a").collect()}
    for run in ("r0", "r1", "r2"):
        active, last = "a", -1e9
        for _, s, best in sorted(x for x in rows if x[0] == run):
            if best != active and s - last >= 300:
                active, last = best, s
            assert got[run, s] == active
    assert got["r0", None] == "a" and len(got) == 401
    assert R.variant_switch(d.where("false"), ["run"], ["ts"]).count() == 0


def test_variant_switch_short_and_long_runs_agree(spark):
    """Runs read by one task (one shuffle, nothing written but the list of long runs) and runs that are spread out give the same rows."""
    import random
    rng = random.Random(6)
    rows = [(rng.choice(["r0", "r0", "r0", "r1", None]), i, None if i % 50 == 7 else i * 40 + rng.randrange(40), rng.choice(["a", "b", "c", None])) for i in range(300)]
    d = spark.createDataFrame(rows, "run string, i long, s long, best string").withColumn("ts", F.timestamp_seconds("s"))
    for start in ("a", None):
        mixed, short, long = (sorted(map(str, R.variant_switch(d, ["run"], ["ts", "i"], hold_s=300, start=start, block=n).collect())) for n in (100, 1000, 0))
        assert short == long == mixed and len(short) == 300
    plan = R.variant_switch(d, ["run"], ["ts", "i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_platt_recovers_slope(spark):
    import math
    import random
    rng = random.Random(1)
    rows = []
    for _ in range(20_000):
        p = rng.choice([.1, .2, .3, .4, .5, .6, .7, .8, .9])
        q = 1 / (1 + math.exp(-(0.6 * math.log(p / (1 - p)) + 0.2)))
        rows.append((p, int(rng.random() < q)))
    r = C.platt_fit(spark.createDataFrame(rows, "true_prob double, won long")).first()
    assert r.a == pytest.approx(0.6, abs=0.05) and r.b == pytest.approx(0.2, abs=0.05)


def test_strict_calibration_uses_closed_bars(spark):
    bars = spark.createDataFrame([("BTC", 300 * i, 100.0 + (i % 3)) for i in range(20)], "asset string, s long, c double").withColumn("ts", F.timestamp_seconds("s"))
    rounds = spark.createDataFrame([("BTC", 3000, "Up")], "asset string, s long, winner string").withColumn("start_ts", F.timestamp_seconds("s"))
    a, b = (C.hist_calibration(rounds, bars, block=16, strict=x).where("side = 'Up'").first() for x in (False, True))
    assert a.won == b.won == 1 and a.llr != b.llr and 0.05 <= a.true_prob <= 0.95
