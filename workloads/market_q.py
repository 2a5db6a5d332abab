"""Bands, positions, exposure, settlement and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.base import round_to
from marketlens.operators import bands as B
from marketlens.operators import calibration as C
from marketlens.operators import positions as P

from . import views as V
from .util import Registry, rnd

REGISTERED = Registry()
add = REGISTERED.add
DAY = 86_400

# ---------------------------------------------------------------- bands
_SAMPLES = """samples AS (SELECT o_orderkey AS slug, epoch_us(o_orderdate) AS t, (o_totalprice % 500) / 1000 AS p_low, o_custkey % 4 = 0 AS low_won FROM orders)"""


def samples(s, d):
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").cast("timestamp").alias("end_ts"),
                    ((F.col("o_totalprice") % 500) / 1000).alias("p_low"), (F.col("o_custkey") % 4 == 0).alias("low_won"))


_GRID = B.price_grid()
_BANDS = ("grid AS (SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in _GRID) + "]) AS g),\n"
          "bands AS (SELECT a.g AS lo, b.g AS hi FROM grid a JOIN grid b ON a.g < b.g)")


@add("band_join", f"WITH {_SAMPLES},\n{_BANDS}\n" + f"""
SELECT lo, hi, count(t) AS n, count(t) FILTER (WHERE low_won) AS wins, {rnd('coalesce(sum(0.99 * (1 / p_low - 1)) FILTER (WHERE low_won), 0)', 4)} AS gp
FROM bands LEFT JOIN samples ON p_low >= lo AND p_low < hi GROUP BY 1, 2""")
def _(s, d):
    return B.band_totals(samples(s, d), _GRID).select("lo", "hi", F.col("n").cast("bigint").alias("n"), F.col("wins").cast("bigint").alias("wins"), round_to("gp", 4).alias("gp"))


_SCAN = f"""bs AS (SELECT lo, hi, t, slug, p_low, low_won, row_number() OVER (PARTITION BY lo, hi ORDER BY t, slug) AS i FROM bands JOIN samples ON p_low >= lo AND p_low < hi),
st AS (SELECT *, i - coalesce(max(CASE WHEN low_won THEN i END) OVER (PARTITION BY lo, hi ORDER BY i), 0) AS streak FROM bs),
scan AS (SELECT lo, hi, count(*) AS n, count(*) FILTER (WHERE low_won) AS wins, sum(CASE WHEN low_won THEN 0.99 * (1 / p_low - 1) ELSE 0 END) AS gp, count(*) FILTER (WHERE NOT low_won) * 0.99 AS gl, max(streak) AS mls FROM st GROUP BY 1, 2)"""
_SCAN_SEL = f"SELECT lo, hi, n, wins, {rnd('wins / n', 6)} AS wr, {rnd('gp / gl', 6)} AS pf, {rnd('30 + gp - gl', 4)} AS bank_final, {rnd('gp - gl', 4)} AS pnl, mls AS max_loss_streak FROM scan WHERE n >= 20 AND gl > 0"


def scan(s, d):
    x = B.band_profit_scan(samples(s, d), grid=_GRID, width_s=180 * DAY)
    return x.select("lo", "hi", F.col("n").cast("bigint").alias("n"), F.col("wins").cast("bigint").alias("wins"), round_to("wr", 6).alias("wr"), round_to("pf", 6).alias("pf"),
                    round_to("bank_final", 4).alias("bank_final"), round_to("pnl", 4).alias("pnl"), "max_loss_streak")


@add("band_profit_scan", f"WITH {_SAMPLES},\n{_BANDS},\n{_SCAN}\n{_SCAN_SEL}")
def _(s, d):
    return scan(s, d)


@add("best_bands", f"WITH {_SAMPLES},\n{_BANDS},\n{_SCAN}\n{_SCAN_SEL} ORDER BY pf DESC, n DESC, lo, hi LIMIT 20")
def _(s, d):
    return B.best_bands(scan(s, d))


@add("low_side_samples", """WITH tp AS (SELECT l_partkey AS pk, CASE WHEN l_linenumber % 2 = 0 THEN 'u' ELSE 'd' END AS tok, epoch_us(l_shipdate) AS t, round(l_discount * 9 + 0.05, 4) AS p FROM lineitem),
m AS (SELECT p_partkey AS pk, epoch_us(TIMESTAMP '2001-06-01') + (p_partkey % 30) * 86400000000 AS e, p_partkey % 2 AS win FROM part),
lp AS (SELECT m.pk, tok, arg_max(p, (t, -p)) AS p FROM m JOIN tp USING (pk) WHERE t BETWEEN e - 2000 * 86400000000 AND e - 400 * 86400000000 GROUP BY 1, 2)
""" + f"""SELECT m.pk AS slug, {rnd('least(u.p, d.p) / (u.p + d.p)', 6)} AS p_low, (CASE WHEN u.p < d.p THEN 0 ELSE 1 END) = win AS low_won
FROM m JOIN lp u ON u.pk = m.pk AND u.tok = 'u' JOIN lp d ON d.pk = m.pk AND d.tok = 'd'""")
def _(s, d):
    x = V.table(s, d, "lineitem")
    tp = x.select(F.concat("l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "u").otherwise("d")).alias("token_id"), F.col("l_shipdate").alias("ts"),
                  F.round(F.col("l_discount") * 9 + 0.05, 4).alias("price"))
    k = F.col("p_partkey")
    m = V.table(s, d, "part").select(k.alias("slug"), F.expr("timestamp_micros(unix_micros(timestamp'2001-06-01') + (p_partkey % 30) * 86400000000)").alias("end_ts"),
                                     F.concat(k, F.lit("u")).alias("token_up"), F.concat(k, F.lit("d")).alias("token_down"), (k % 2).alias("winner_idx"))
    r = B.low_side_samples(m, tp, from_s=2000 * DAY, to_s=400 * DAY)
    return r.select("slug", round_to("p_low", 6).alias("p_low"), "low_won")


@add("dedupe_slug", """SELECT o_custkey::VARCHAR AS slug, arg_min(o_orderkey, o_orderkey) AS seq, epoch_us(arg_min(o_orderdate, o_orderkey)) AS end_us FROM orders GROUP BY 1""")
def _(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("end_ts"))
    return B.dedupe_slug(o).select("slug", "seq", V.us("end_ts").alias("end_us"))


# ---------------------------------------------------------------- positions
@add("top_positions", V.with_views("positions") + f"SELECT condition_id, outcome, {rnd('current_value', 4)} AS current_value FROM positions WHERE outcome <> '' AND current_value >= 0.01 ORDER BY positions.current_value DESC, condition_id LIMIT 20")
def _(s, d):
    return P.top_positions(V.positions(s, d), 20).select("condition_id", "outcome", round_to("current_value", 4).alias("current_value"))


@add("position_changes", V.with_views("positions", """g AS (SELECT wallet % 40 AS w, t // 2592000000000 AS m, count(*) FILTER (WHERE NOT redeemable) AS open_n, count(*) FILTER (WHERE redeemable) AS redeem_n,
         coalesce(sum(floor(current_value / 16)) FILTER (WHERE NOT redeemable), 0) AS open_value, coalesce(sum(floor(current_value / 16)) FILTER (WHERE redeemable), 0) AS redeem_value
       FROM positions WHERE outcome <> '' AND floor(current_value / 16) > 0 GROUP BY 1, 2)""", """l AS (SELECT *, lag((open_n, open_value, redeem_n, redeem_value)) OVER (PARTITION BY w ORDER BY m) AS prev FROM g)""") + """
SELECT w AS wallet, m AS month, open_n, open_value, redeem_n, redeem_value, prev IS NULL OR prev <> (open_n, open_value, redeem_n, redeem_value) AS changed FROM l""")
def _(s, d):
    # Values in coarse units, so equal signatures follow each other now and then.
    x = V.positions(s, d).select((F.col("wallet") % 40).alias("wallet"), "outcome", "redeemable", F.floor(F.col("current_value") / 16).cast("double").alias("current_value"),
                                 F.expr("timestamp_micros(unix_micros(snapshot_ts) div 2592000000000 * 2592000000000)").alias("snapshot_ts"))
    r = P.position_changes(x, block=16)
    return r.select("wallet", F.expr("unix_micros(snapshot_ts) div 2592000000000").alias("month"), "open_n", "open_value", "redeem_n", "redeem_value", "changed")


_PEND = """pending AS (SELECT o_orderkey + 3000 AS condition_id, epoch_us(o_orderdate) / 1e6 AS placed_s, CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE epoch_us(o_orderdate) / 1e6 + 900 END AS end_s FROM orders),
venue AS (SELECT condition_id, outcome, current_value - 20 AS current_value, redeemable, (condition_id % 50)::DOUBLE AS size FROM positions)"""
_NOW = 915148860.0


def pending(s, d):
    o = V.table(s, d, "orders")
    t = V.us("o_orderdate") / 1e6
    return o.select((F.col("o_orderkey") + 3000).alias("condition_id"), t.alias("placed_s"), F.when(F.col("o_custkey") % 5 == 0, 0.0).otherwise(t + 900).alias("end_s"))


@add("reconcile_positions", V.with_views("positions", _PEND, """j AS (SELECT condition_id, p.placed_s, p.end_s, p.condition_id IS NOT NULL AS lo, v.condition_id IS NOT NULL AS th, outcome, current_value AS cv, coalesce(redeemable, false) AS red, size,
       coalesce(condition_id % 9 = 0, false) AS q, coalesce(condition_id % 8 = 0, false) AS rd FROM pending p FULL JOIN venue v USING (condition_id))""", f"""a AS (SELECT *, CASE
    WHEN lo AND th AND red AND cv >= 0.01 AND NOT q THEN 'redeem' WHEN lo AND th AND red THEN 'loss'
    WHEN lo AND ((th AND NOT red AND outcome <> '' AND cv >= 0.5) OR q OR (placed_s > 0 AND {_NOW} - placed_s < 90) OR (end_s > {_NOW} AND end_s - {_NOW} < 90)) THEN 'keep' WHEN lo THEN 'prune'
    WHEN th AND red AND outcome <> '' AND cv >= 0.01 AND NOT q AND NOT rd THEN 'queue_redeem' WHEN th AND NOT red AND outcome <> '' AND cv >= 0.5 AND NOT q AND NOT rd THEN 'recover' ELSE 'ignore' END AS action FROM j)""") +
     f"SELECT condition_id, action, {rnd('''CASE WHEN action = 'recover' THEN CASE WHEN size > 0 THEN cv / size ELSE 0.5 END END''', 6)} AS recovered_entry FROM a")
def _(s, d):
    v = V.positions(s, d).withColumn("current_value", F.col("current_value") - 20).withColumn("size", (F.col("condition_id") % 50).cast("double"))
    p = pending(s, d)
    ids = p.select("condition_id").union(v.select("condition_id")).distinct()
    r = P.reconcile_positions(p, v, _NOW, queued=ids.where("condition_id % 9 = 0"), redeemed=ids.where("condition_id % 8 = 0"))
    return r.withColumn("recovered_entry", round_to("recovered_entry", 6))


@add("settlement_queue", V.with_views("positions", _PEND) + f"SELECT condition_id FROM pending WHERE end_s > 0 AND end_s <= {_NOW} AND condition_id NOT IN (SELECT condition_id FROM positions WHERE redeemable)")
def _(s, d):
    return P.settlement_queue(pending(s, d), V.positions(s, d).where("redeemable"), _NOW).select("condition_id")


@add("open_position_view", V.with_views("signals") + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ref THEN 'LIVE' ELSE 'UNSETTLED' END AS status, CASE WHEN ref AND win = side THEN 'LEAD' WHEN ref THEN 'TRAIL' ELSE 'NA' END AS standing,
  {rnd('CASE WHEN ref THEN (cur - op) / op * 100 END', 6)} AS move_pct, {rnd('CASE WHEN ref AND win = side THEN 2.5 / entry ELSE 0 END', 6)} AS payout_est, {rnd('greatest(0, (mins_left * 60 - 120) / 60)', 6)} AS mins_left
FROM (SELECT *, op > 0 AND cur > 0 AS ref, CASE WHEN cur >= op THEN 'Up' ELSE 'Down' END AS win FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE open_price END AS op,
  CASE WHEN l_partkey % 4 > 0 THEN "current" WHEN l_partkey % 8 = 0 THEN 100.1 ELSE 0 END AS cur FROM signals))""")
def _(s, d):
    k = F.col("l_partkey")
    x = V.signals(s, d).withColumns({
        "open_price": F.when(k % 9 == 0, 0.0).otherwise(F.col("open_price")), "oracle": F.when(k % 4 > 0, F.col("current")).otherwise(0.0),
        "tick": F.when(k % 8 == 0, 100.1).otherwise(0.0), "size": F.lit(2.5), "end_s": F.col("mins_left") * 60.0})
    r = P.open_position_view(x, 120.0)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "standing",
                    *[round_to(c, 6).alias(c) for c in ("move_pct", "payout_est", "mins_left")])


@add("local_counts", V.with_views("positions", _PEND) + f"SELECT (SELECT count(*) FROM pending WHERE end_s <= 0 OR end_s > {_NOW}) AS open_local, (SELECT count(*) FROM positions WHERE redeemable) AS settling_local")
def _(s, d):
    return P.local_counts(pending(s, d), V.positions(s, d).where("redeemable"), _NOW)


@add("cross_asset_agreement", V.with_views("rounds") + """
SELECT a.asset, a.start_t AS start_us, count(b.asset) FILTER (WHERE b.close > b.open) AS others_up, count(b.asset) FILTER (WHERE b.close <= b.open) AS others_down
FROM rounds a LEFT JOIN rounds b ON a.start_t = b.start_t AND a.asset <> b.asset AND b.open > 0 AND b.close > 0 GROUP BY 1, 2""")
def _(s, d):
    r = P.cross_asset_agreement(V.rounds(s, d).withColumn("price", F.col("close")), ["start_ts"])
    return r.select("asset", V.us("start_ts").alias("start_us"), "others_up", "others_down")


@add("same_round_exposure", V.with_views("signals") + f"""
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, {rnd('coalesce(sum(b.entry) FILTER (WHERE b.side = a.side), 0) - a.entry', 4)} AS same_side_size, {rnd('coalesce(sum(b.entry) FILTER (WHERE b.side <> a.side), 0)', 4)} AS opp_side_size,
  count(*) FILTER (WHERE b.side = a.side) - 1 AS same_side_legs, count(*) - 1 AS round_legs
FROM signals a JOIN signals b ON a.l_partkey = b.l_partkey GROUP BY 1, 2, 3, 4, a.entry, a.side, a.t""")
def _(s, d):
    x = V.signals(s, d).withColumn("size", F.col("entry")).withColumn("fingerprint", F.col("l_partkey"))
    r = P.same_round_exposure(x)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_to("same_side_size", 4).alias("same_side_size"), round_to("opp_side_size", 4).alias("opp_side_size"), "same_side_legs", "round_legs")


_UNI = """uni AS (SELECT DISTINCT condition_id, outcome AS side, 'activity' AS source FROM trades WHERE outcome <> ''
  UNION SELECT condition_id, outcome, 'pending_file' FROM positions WHERE outcome <> '' UNION SELECT condition_id, side, 'metrics_file' FROM resolves),
payouts AS (SELECT p_partkey AS condition_id, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS denom, p_partkey % 2 AS n0, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 1 - p_partkey % 2 END AS n1 FROM part),
claims AS (SELECT u.condition_id, u.side, 'x' AS winner, (u.condition_id % 11) / 10.0 AS qty FROM (SELECT DISTINCT condition_id, side FROM uni) u JOIN payouts p USING (condition_id)
  WHERE u.side = CASE WHEN denom > 0 AND n0 > 0 AND n1 = 0 THEN 'Up' WHEN denom > 0 AND n1 > 0 AND n0 = 0 THEN 'Down' END AND u.condition_id % 11 > 0)"""


def universe(s, d):
    act = V.trades(s, d).withColumn("type", F.lit("trade")).withColumn("outcome", F.upper("outcome"))
    pend = V.positions(s, d).select("condition_id", F.lower("outcome").alias("side"))
    met = V.resolves(s, d).select("condition_id", "side")
    return P.cid_side_universe(act, pend, met)


def claims(s, d):
    k = F.col("p_partkey")
    pay = V.table(s, d, "part").select(k.alias("condition_id"), F.when(k % 7 == 0, 0).otherwise(1).alias("denom"), (k % 2).alias("n0"), F.when(k % 13 == 0, 1).otherwise(1 - k % 2).alias("n1"))
    bal = V.table(s, d, "part").select(k.alias("condition_id"), F.explode(F.array(F.lit("Up"), F.lit("Down"))).alias("side"), ((k % 11) / 10.0).alias("qty"))
    return P.claimable(universe(s, d), pay, bal)


@add("cid_side_universe", V.with_views("trades positions resolves", _UNI) + "SELECT condition_id, side, count(*) AS sources FROM uni GROUP BY 1, 2")
def _(s, d):
    return universe(s, d).groupBy("condition_id", "side").agg(F.count("*").alias("sources"))


@add("claimable", V.with_views("trades positions resolves", _UNI) + "SELECT condition_id, side, qty FROM claims")
def _(s, d):
    return claims(s, d).select("condition_id", "side", "qty")


@add("redeem_report", V.with_views("trades positions resolves", _UNI) + """
SELECT 'source' AS kind, source AS name, count(DISTINCT condition_id) AS n FROM uni GROUP BY 2 UNION ALL SELECT 'stage', 'claimable', count(*) FROM claims
UNION ALL SELECT 'stage', 'redeemed', count(*) FROM claims WHERE condition_id % 3 = 0 UNION ALL SELECT 'stage', 'errors', count(*) FROM claims WHERE condition_id % 10 = 1""")
def _(s, d):
    c = claims(s, d)
    return P.redeem_report(universe(s, d), c, c.where("condition_id % 3 = 0"), c.where("condition_id % 10 = 1"))


@add("equity_summary", V.with_views("positions", f"""h AS (SELECT wallet % 10 AS w, CASE outcome WHEN 'Up' THEN 'Up' ELSE 'Down' END AS side, {rnd('current_value - 5', 4)} AS qty, CASE WHEN condition_id % 3 = 0 THEN 0 ELSE 0.4 END AS tp, (condition_id % 10) / 10.0 AS up FROM positions WHERE NOT redeemable)""",
     f"c AS (SELECT wallet % 10 AS w, {rnd('current_value - 5', 4)} AS qty FROM positions WHERE redeemable)",
     "hg AS (SELECT w, sum(qty * CASE WHEN tp > 0 THEN tp WHEN side = 'Up' THEN up ELSE 1 - up END) AS ov, count(*) AS n FROM h WHERE qty > 0 GROUP BY 1)", "cg AS (SELECT w, sum(qty) AS cv, count(*) AS n FROM c WHERE qty > 0 GROUP BY 1)") + f"""
SELECT hg.w AS wallet, {rnd('ov', 4)} AS open_value, hg.n AS open_n, {rnd('cv', 4)} AS claim_value, cg.n AS claim_n, {rnd('50 + ov + cv', 2)} AS equity, {rnd('50 + ov + cv - 1000', 2)} AS pnl FROM hg JOIN cg USING (w)""")
def _(s, d):
    p = V.positions(s, d).withColumn("wallet", F.col("wallet") % 10).withColumn("qty", round_to(F.col("current_value") - 5, 4))
    k = F.col("condition_id")
    h = p.where("NOT redeemable").withColumns({"side": F.when(F.col("outcome") == "Up", "Up").otherwise("Down"), "token_price": F.when(k % 3 == 0, 0.0).otherwise(0.4), "up_price": (k % 10) / 10.0})
    r = P.equity_summary(50.0, h, p.where("redeemable"), ["wallet"], baseline=1000.0)
    return r.withColumns({"open_value": round_to("open_value", 4), "claim_value": round_to("claim_value", 4), "equity": round_to("equity", 2), "pnl": round_to("pnl", 2)})


@add("core_addon_split", V.with_views("resolves") + f"""
SELECT condition_id, arg_min(size, (t, seq)) FILTER (WHERE NOT ad) AS core_size, arg_min(entry, (t, seq)) FILTER (WHERE NOT ad) AS core_entry, count(*) FILTER (WHERE ad) AS addon_count, {rnd('coalesce(sum(size) FILTER (WHERE ad), 0)', 4)} AS addon_stake
FROM (SELECT *, l_linenumber > 3 AS ad, l_linenumber * 1000000 + l_partkey AS seq FROM resolves) GROUP BY 1""")
def _(s, d):
    x = V.resolves(s, d).withColumn("is_addon", F.col("l_linenumber") > 3).withColumn("seq", F.col("l_linenumber") * 1_000_000 + F.col("l_partkey"))
    return P.core_addon_split(x).withColumn("addon_stake", round_to("addon_stake", 4))


@add("paper_resolve", V.with_views("rounds") + f"""
SELECT asset, start_t AS start_us, side, CASE WHEN won THEN 'WIN' ELSE 'LOSS' END AS result, {rnd('CASE WHEN won THEN 2 * (1 / 0.45 - 1) - 2 * 0.0156 * (1 - abs(0.45 - 0.5) * 2) ELSE -2 END', 6)} AS pnl
FROM (SELECT *, CASE side WHEN 'Up' THEN close >= open ELSE close < open END AS won FROM rounds, (VALUES ('Up'), ('Down')) v(side) WHERE close IS NOT NULL)""")
def _(s, d):
    r = V.rounds(s, d).where("close IS NOT NULL").withColumn("side", F.explode(F.array(F.lit("Up"), F.lit("Down"))))
    x = P.paper_resolve(r.withColumns({"size": F.lit(2.0), "entry": F.lit(0.45), "mkt_price": F.lit(0.45)}))
    return x.select("asset", V.us("start_ts").alias("start_us"), "side", "result", round_to("pnl", 6).alias("pnl"))


@add("prebid_arm", V.with_views("trades", """fl AS (SELECT condition_id, t, sum(price) AS a, sum(1 - price) AS b FROM trades GROUP BY 1, 2)""", "f2 AS (SELECT condition_id, t, a / (a + b) AS up, b / (a + b) AS down FROM fl)",
     "rd AS (SELECT p_partkey AS condition_id, epoch_us(TIMESTAMP '1998-01-01') + (p_partkey % 400) * 86400000000 AS s FROM part)",
     "c AS (SELECT condition_id, s, arg_max(up, t) AS up, arg_max(down, t) AS down FROM f2 JOIN rd USING (condition_id) WHERE t < s AND s - t <= 15552000000000 AND greatest(up, down) >= 0.58 GROUP BY 1, 2)") + f"""
SELECT condition_id, CASE WHEN up >= down THEN 'Up' ELSE 'Down' END AS side, {rnd('greatest(up, down)', 4)} AS conf, s / 1e6 AS valid_from_s, s / 1e6 + 30 AS valid_to_s FROM c""")
def _(s, d):
    f = V.trades(s, d).groupBy("condition_id", "ts").agg(F.sum("price").alias("a"), F.sum(1 - F.col("price")).alias("b"))
    f = f.select("condition_id", "ts", (F.col("a") / (F.col("a") + F.col("b"))).alias("up"), (F.col("b") / (F.col("a") + F.col("b"))).alias("down"))
    r = V.table(s, d, "part").select(F.col("p_partkey").alias("condition_id"), F.expr("timestamp_micros(unix_micros(timestamp'1998-01-01') + (p_partkey % 400) * 86400000000)").alias("start_ts"))
    return P.prebid_arm(f, r, lead_s=180 * DAY).select("condition_id", "side", round_to("conf", 4).alias("conf"), "valid_from_s", "valid_to_s")


@add("retry_cooldown", V.with_views("activity") + """
SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY condition_id % 10, type ORDER BY t, event_id) < 3600000000, false) AS blocked FROM activity""")
def _(s, d):
    a = V.activity(s, d).withColumn("k", F.col("condition_id") % 10)
    return P.retry_cooldown(a, ["k", "type"], ["ts", "event_id"], cooldown_s=3600, block=64).select("event_id", "blocked")


@add("order_status_fold", f"""SELECT l_orderkey AS order_id, arg_max(l_returnflag, (epoch_us(l_shipdate), l_linenumber * 1000000 + l_partkey)) AS status, max(q) AS filled_shares,
  {rnd('max(q) * arg_max(l_discount, (epoch_us(l_shipdate), l_linenumber * 1000000 + l_partkey))', 4)} AS filled_usdc, CASE WHEN max(q) <= 0 THEN 'none' WHEN max(q) + 1e-9 < 40 THEN 'partial' ELSE 'filled' END AS state
FROM (SELECT *, greatest(0, l_quantity - 5)::DOUBLE AS q FROM lineitem) GROUP BY 1""")
def _(s, d):
    x = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"),
                                         F.col("l_returnflag").alias("status"), F.greatest(F.lit(0.0), F.col("l_quantity") - 5).alias("filled_shares"), F.col("l_discount").alias("price"), F.lit(40.0).alias("size"))
    return P.order_status_fold(x).select("order_id", "status", "filled_shares", round_to("filled_usdc", 4).alias("filled_usdc"), "state")


@add("exposure_caps", V.with_views("bars") + """
SELECT t AS t_us, count(*) FILTER (WHERE v > 3 AND c > o) AS trending, count(*) AS assets, CASE WHEN count(*) FILTER (WHERE v > 3 AND c > o) >= greatest(1, count(*) // 2) THEN 0.80 ELSE 0.60 END::DOUBLE AS total_cap,
  CASE WHEN count(*) FILTER (WHERE v > 3 AND c > o) >= greatest(1, count(*) // 2) THEN 0.55 ELSE 0.40 END::DOUBLE AS side_cap FROM bars GROUP BY 1""")
def _(s, d):
    b = V.bars(s, d).withColumn("vr", F.when(F.col("v") > 3, 1.1).otherwise(0.9)).withColumn("ac", F.when(F.col("c") > F.col("o"), 0.1).otherwise(-0.1))
    return P.exposure_caps(b, ["ts"]).select(V.us("ts").alias("t_us"), "trending", "assets", "total_cap", "side_cap")


# Slots of a wallet and year hold some 85 signals, far over max_open; one position is held at the start of each. Sizes are
# exact binary fractions, so sums do not depend on rounding.
_PICK = """sg AS (SELECT l_suppkey AS w, year(l_shipdate) AS y, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS r,
    l_orderkey AS k, l_linenumber AS l, l_partkey % 40 AS c, l_partkey % 12 AS f, CASE WHEN l_linestatus = 'O' THEN 'Up' ELSE 'Down' END AS s, l_quantity * 0.125 AS z FROM lineitem),
ls AS (SELECT w, y, list({'k': k, 'l': l, 'c': c, 'f': f, 's': s, 'z': z::DOUBLE} ORDER BY r) AS xs, CASE WHEN y % 2 = 0 THEN 12.0 ELSE 60.0 END AS tc, CASE WHEN y % 2 = 0 THEN 8.0 ELSE 25.0 END AS sc FROM sg GROUP BY 1, 2),
pk AS (SELECT w, y, list_reduce(xs, lambda a, x: CASE WHEN len(a.p) < 8 AND len(list_filter(a.p, lambda q: (q.c = x.c OR q.f = x.f) AND q.s <> x.s AND q.z > 0)) = 0
      AND (len(list_filter(a.p, lambda q: q.c = x.c)) = 0 OR coalesce(list_sum(list_transform(list_filter(a.p, lambda q: q.c = x.c AND q.s = x.s), lambda q: q.z)), 0) + x.z <= 10)
      AND (len(list_filter(a.p, lambda q: q.f = x.f)) = 0 OR coalesce(list_sum(list_transform(list_filter(a.p, lambda q: q.f = x.f AND q.s = x.s), lambda q: q.z)), 0) + x.z <= 10)
      AND coalesce(list_sum(list_transform(a.p, lambda q: q.z)), 0) + x.z <= a.tc AND coalesce(list_sum(list_transform(list_filter(a.p, lambda q: q.s = x.s), lambda q: q.z)), 0) + x.z <= a.sc
    THEN {'p': list_append(a.p, x), 'tc': a.tc, 'sc': a.sc} ELSE a END,
  {'p': [{'k': 0::BIGINT, 'l': 0::INT, 'c': w % 40, 'f': 99::BIGINT, 's': 'Up', 'z': 3.0::DOUBLE}], 'tc': tc::DOUBLE, 'sc': sc::DOUBLE}).p[2:] AS ps FROM ls)"""


@add("pick_with_caps", f"WITH {_PICK} SELECT w AS wallet, y AS period, p.k AS l_orderkey, p.l AS l_linenumber, p.s AS side, p.z AS size FROM (SELECT w, y, unnest(ps) AS p FROM pk)")
def _(s, d):
    x = V.table(s, d, "lineitem")
    y = F.year("l_shipdate").cast("bigint")
    sig = x.select(F.col("l_suppkey").alias("wallet"), y.alias("period"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("rank"), "l_orderkey", "l_linenumber",
                   (F.col("l_partkey") % 40).alias("condition_id"), (F.col("l_partkey") % 12).alias("fingerprint"), F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down").alias("side"),
                   (F.col("l_quantity") * 0.125).cast("double").alias("size"), F.when(y % 2 == 0, 0.12).otherwise(0.60).alias("tc"), F.when(y % 2 == 0, 0.08).otherwise(0.25).alias("sc"))
    held = sig.select("wallet", "period").distinct().withColumns({"condition_id": F.col("wallet") % 40, "fingerprint": F.lit(99).cast("bigint"), "side": F.lit("Up"), "size": F.lit(3.0)})
    got = P.pick_with_caps(sig, ["wallet", "period"], bankroll=100.0, total_cap="tc", side_cap="sc", open_positions=held)
    return got.select("wallet", "period", "l_orderkey", "l_linenumber", "side", "size")


# ---------------------------------------------------------------- calibration
_HIST = """rr AS (SELECT asset, start_t, CASE WHEN close >= open THEN 'Up' ELSE 'Down' END AS winner FROM rounds),
rb AS (SELECT *, (c - lag(c) OVER (PARTITION BY asset ORDER BY t)) / lag(c) OVER (PARTITION BY asset ORDER BY t) AS r FROM bars),
ft AS (SELECT asset, t, c, count(*) OVER w13 AS n, count(r) OVER w12 AS k, greatest(sqrt(avg(r * r) OVER w12), 1e-8) AS sg, (c - first_value(c) OVER w12b) / first_value(c) OVER w12b AS disp FROM rb
  WINDOW w13 AS (PARTITION BY asset ORDER BY t ROWS 13 PRECEDING), w12 AS (PARTITION BY asset ORDER BY t ROWS 12 PRECEDING), w12b AS (PARTITION BY asset ORDER BY t ROWS 12 PRECEDING)),
ld AS (SELECT * FROM ft WHERE asset = 'click'),
j0 AS (SELECT r.*, f.n, f.k, f.sg, f.disp FROM rr r ASOF JOIN ft f ON r.asset = f.asset AND f.t <= r.start_t),
j1 AS (SELECT j.*, l.n AS ln, l.k AS lk, l.sg AS ls, l.c AS lc FROM j0 j ASOF LEFT JOIN ld l ON l.t <= j.start_t),
j2 AS (SELECT j.*, l.c AS l0 FROM j1 j ASOF LEFT JOIN ld l ON l.t <= j.start_t - 1800000000),
h AS (SELECT asset, start_t // 1000000 AS round_ts, winner, disp / (sg * sqrt(3)) * 0.8 + CASE WHEN asset <> 'click' AND ln >= 5 AND lk >= 1 AND l0 > 0 THEN (lc - l0) / l0 / (ls * sqrt(3)) * 0.77 * 0.8 ELSE 0 END AS llr FROM j2 WHERE n >= 5 AND k >= 3),
hist AS (SELECT asset, round_ts, side, (side = winner)::BIGINT AS won, round(llr, 6) AS llr, round(greatest(0.05, least(0.95, CASE side WHEN 'Up' THEN 1 / (1 + exp(-llr)) ELSE 1 - 1 / (1 + exp(-llr)) END)), 6) AS true_prob FROM h, (VALUES ('Up'), ('Down')) v(side))"""


def hist(s, d):
    r = V.rounds(s, d).withColumn("winner", F.when(F.col("close") >= F.col("open"), "Up").otherwise("Down"))
    return C.hist_calibration(r, V.bars(s, d), leader="click", block=256)


@add("hist_calibration", V.with_views("bars rounds", _HIST) + "SELECT asset, round_ts, side, won, llr, true_prob FROM hist")
def _(s, d):
    return hist(s, d)


@add("upsert_hist_calib", V.with_views("bars rounds", _HIST) + "SELECT asset, round_ts, side, won, llr, true_prob FROM hist WHERE (round_ts // 21600) % 3 > 0")
def _(s, d):
    h = hist(s, d)
    return C.new_rows(h.union(h), h.where(F.expr("(round_ts div 21600) % 3 = 0")))


@add("calibration_curve", V.with_views("bars rounds", _HIST) + f"""
SELECT least(18, floor((true_prob - 0.05) / 0.9 * 18)::BIGINT + 1) AS bin, count(*) AS n, {rnd('avg(true_prob)', 6)} AS mean_prob, {rnd('avg(won)', 6)} AS win_rate, {rnd('avg(power(true_prob - won, 2))', 6)} AS brier FROM hist GROUP BY 1""")
def _(s, d):
    x = C.calibration_curve(hist(s, d))
    return x.withColumns({k: round_to(k, 6) for k in ("mean_prob", "win_rate", "brier")})


def _newton() -> str:
    """Newton steps on the counted (p, won) cells as one fold over a range."""
    q = "(1 / (1 + exp(-(s.a * c.x + s.b))))"
    total = lambda e: f"list_sum(list_transform(cs, lambda c: {e}))"
    ga, gb = total(f"c.n * (c.y - {q}) * c.x"), total(f"c.n * (c.y - {q})")
    haa, hab, hbb = (total(f"c.n * {q} * (1 - {q}){m}") for m in (" * c.x * c.x", " * c.x", ""))
    det = f"({haa} * {hbb} - {hab} * {hab})"
    return f"""cl AS (SELECT list({{'x': ln(p / (1 - p)), 'y': won::DOUBLE, 'n': n::DOUBLE}}) AS cs FROM (SELECT true_prob AS p, won, count(*) AS n FROM hist GROUP BY 1, 2)),
nw AS (SELECT list_reduce(range(12), lambda s, i: {{'a': s.a + ({hbb} * {ga} - {hab} * {gb}) / {det}, 'b': s.b + ({haa} * {gb} - {hab} * {ga}) / {det}}}, {{'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE}}) AS f FROM cl)"""


@add("platt_fit", V.with_views("bars rounds", _HIST, _newton()) + f"SELECT {rnd('f.a', 4)} AS a, {rnd('f.b', 4)} AS b FROM nw")
def _(s, d):
    return C.platt_fit(hist(s, d)).withColumns({"a": round_to("a", 4), "b": round_to("b", 4)})
