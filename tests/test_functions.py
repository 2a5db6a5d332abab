import math

import pytest
from pyspark.sql import functions as F

from marketlens.functions import gates as G
from marketlens.functions import normalize as N
from marketlens.functions import prob as P
from marketlens.functions import rounds as R
from marketlens.operators.wallets import leader_composite


def one(spark, **cols):
    return spark.range(1).select(*[(c if hasattr(c, "alias") else F.lit(c)).alias(k) for k, c in cols.items()]).first().asDict()


def signals(spark, *rows):
    return spark.createDataFrame(rows, "asset string, duration int, side string, score int, true_prob double, entry double, payout_mult double, execution_ev double")


def test_core_gate_names_first_failure(spark):
    s = signals(spark, ("BTC", 15, "Up", 12, .61, .59, 1.69, .03))
    assert s.select(G.core_gate_reason(min_score=10, min_payout=1.72, min_ev=.01)).first()[0] == "payout_below"


def test_decide(spark):
    s = signals(spark, ("ETH", 15, "Down", 12, .62, .55, 1.82, .028), ("BTC", 15, "Up", 12, .57, .56, 1.78, .001))
    got = [(r.reason, r.notional_usdc) for r in G.decide(s, 100.0).collect()]
    assert got == [("ok", 2.5), ("ev_below", None)]


LEADERS = [(0.6, 0.1, 0.6, 30), (0.45, -0.2, 0.45, 8), (0.9, 0.9, 0.9, 90)]
# Published leader rows (wr, roi, same side ratio, settled, score), rounded to 4 places.
GOLDEN = [(0.9639, -0.0079, 0.7937, 83, 0.83), (1.0, 0.0211, 0.8243, 22, 0.8184), (1.0, 0.0576, 0.6078, 75, 0.7836)]


@pytest.mark.parametrize("wr,roi,aff,n,score", GOLDEN)
def test_leader_golden(spark, wr, roi, aff, n, score):
    assert one(spark, s=leader_composite(F.lit(wr), F.lit(roi), F.lit(aff), F.lit(n)))["s"] == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("wr,roi,aff,n", LEADERS)
def test_leader_composite(spark, wr, roi, aff, n):
    cl = lambda x: max(0.0, min(1.0, x))
    want = cl((wr - .45) / .2) * .45 + cl((roi + .2) / .6) * .25 + cl((aff - .45) / .25) * .2 + cl(math.log1p(n) / math.log1p(60)) * .1
    got = one(spark, s=leader_composite(F.lit(wr), F.lit(roi), F.lit(aff), F.lit(n)))["s"]
    assert got == pytest.approx(want, abs=1e-12)


def test_normal_cdf_accuracy(spark):
    rows = spark.range(-600, 601).select((F.col("id") / 100.0).alias("z")).select("z", P.norm_cdf("z").alias("p")).collect()
    assert max(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) for r in rows) < 1e-7


def test_prob_and_size_edges(spark):
    r = one(spark, bad=P.prob_up(F.lit(0.0), F.lit(1.0), F.lit(5.0), F.lit(.5)), tie=P.prob_up(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(.5)),
            none=P.wilson_lb(F.lit(0), F.lit(0)), all_=P.wilson_lb(F.lit(10), F.lit(10)), kz=P.kelly_size(F.lit(.6), F.lit(0.0), .1, 100.0),
            k1=P.kelly_size(F.lit(.6), F.lit(1.0), .1, 100.0), kk=P.kelly_size(F.lit(.6), F.lit(.5), .1, 100.0))
    assert r["bad"] == 0.5 and r["tie"] == pytest.approx(0.5, abs=1e-7)
    assert r["none"] == 0.5 and r["all_"] == pytest.approx(10 / 11)
    assert r["kz"] == 1.0 and r["k1"] == 1.0 and r["kk"] == pytest.approx(2.0)


def test_book_depth_stops_at_first_dearer_level(spark):
    lv = F.array(*[F.struct(F.lit(p).alias("price"), F.lit(s).alias("size")) for p, s in ((.4, 10.0), (.6, 5.0), (.41, 100.0))])
    assert one(spark, d=P.book_depth_usdc(lv, .5))["d"] == pytest.approx(4.0)


def test_classification(spark):
    r = one(spark, batch=N.classify_activity(F.lit("trade"), F.lit(None).cast("string"), side_default_buy=True),
            live=N.classify_activity(F.lit("trade"), F.lit(None).cast("string"), side_default_buy=False),
            red=N.classify_activity(F.lit("Redeem"), F.lit("x"), side_default_buy=False),
            tie=N.winner_by_argmax(F.lit(.5), F.lit(.5)), zero=N.winner_by_payout(F.lit(0), F.lit(1), F.lit(0)),
            both=N.winner_by_payout(F.lit(1), F.lit(1), F.lit(1)), iso=F.unix_seconds(N.parse_iso(F.lit("2026-02-21T08:30:00Z")).cast("timestamp")), bad=N.parse_iso(F.lit("soon")))
    assert (r["batch"], r["live"], r["red"]) == ("BUY", "OTHER", "REDEEM")
    assert r["tie"] == 1 and r["zero"] is None and r["both"] is None and r["iso"] == 1771662600 and r["bad"] is None


@pytest.mark.parametrize("title,start,end", [
    ("Bitcoin Up or Down - February 21, 8:30AM-8:45AM ET", 1771680600, 1771681500),
    ("February 21, 8:30-8:45AM ET", 1771680600, 1771681500),
    ("July 1, 11:45PM-12:00AM ET", 1782963900, 1782963900 + 86400),
    ("no window here", None, None)])
def test_title_bounds(spark, title, start, end):
    s, e = R.bounds_from_title(F.lit(title), 2026)
    r = one(spark, s=s, e=e)
    assert (r["s"], r["e"]) == (start, end)


def test_title_window_and_key(spark):
    t = "Bitcoin Up or Down - February 21, 8:30AM-8:45AM ET"
    s, e = R.window_from_title(F.lit(t), F.lit(15), F.lit(1.0), F.lit(2.0), 2026)
    es, ee = R.window_from_title(F.lit(t), F.lit(15), F.lit(1.0), F.lit(2.0), 2026, expired_before_s=F.lit(1771681000.0))
    k = R.round_key(F.lit("btc"), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit("0xabcdef0123456789"), F.lit(t), 2026)
    n = R.round_key(F.lit("btc"), F.lit(15), F.lit(0.0), F.lit(0.0), F.lit("0xabcdef0123456789"))
    r = one(spark, s=s, e=e, es=es, ee=ee, k=k, n=n)
    assert (r["s"], r["e"], r["es"], r["ee"]) == (1771680600, 1771681500, 1.0, 2.0)
    assert r["k"] == "BTC-15m-20260221T133000Z-20260221T134500Z" and r["n"] == "BTC-15m-cid0xabcdef0123456789"


def test_title_is_matched_once_per_window(spark):
    d = spark.createDataFrame([("Bitcoin - February 21, 8:30-8:45AM ET",), ("February 30, 8:30AM-8:45AM ET",), ("none",), (None,)], "t string")
    st, en = R.window_from_title("t", F.lit(15), F.lit(1.0), F.lit(2.0), 2026)
    got = d.select(st.alias("st"), en.alias("en"))
    assert [tuple(r) for r in got.collect()] == [(1771680600.0, 1771681500.0), (1.0, 2.0), (1.0, 2.0), (1.0, 2.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") <= 12, plan.count("gettimestamp")  # two per use of the window, not per use of a bound in it


def test_families_and_quotes(spark):
    a, m = N.classify_family(F.lit("eth-up-or-down-5m"), F.lit(""))
    b, k = N.classify_family(F.lit(None).cast("string"), F.lit("Solana Up or Down 15m"))
    lv = lambda *x: F.array(*[F.struct(F.lit(p).alias("price"), F.lit(1.0).alias("size")) for p in x])
    bid, ask = P.best_quotes(lv(.4, .45), lv(.6, .5))
    bid0, _ = P.best_quotes(F.array().cast("array<struct<price: double, size: double>>"), lv(.6, .5))
    r = one(spark, a=a, m=m, b=b, k=k, f=N.slug_filter(F.lit("btc-updown-5m-1771")), g=N.slug_filter(F.lit("sol-updown-5m-1771")), bid=bid, ask=ask, bid0=bid0)
    assert (r["a"], r["m"], r["b"], r["k"], r["f"], r["g"]) == ("ETH", 5, "SOL", 15, True, False)
    assert (r["bid"], r["ask"]) == (.45, .5) and r["bid0"] == pytest.approx(.4)
