"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.base import round_to
from marketlens.operators import asof as A

from . import views as V
from .util import Registry, rnd

REGISTERED = Registry()
add = REGISTERED.add


@add("asof_backward", V.with_views("bars slots") + """
SELECT s.asset, s.start_t AS start_us, b.c AS close FROM slots s ASOF LEFT JOIN bars b ON s.asset = b.asset AND b.t <= s.start_t""")
def _(s, d):
    r = A.asof_backward(V.round_slots(s, d), V.bars(s, d), ["asset"], left_ts="start_ts", right_ts="ts", take={"close": "c"})
    return r.select("asset", V.us("start_ts").alias("start_us"), "close")


@add("asof_last_n", V.with_views("bars slots") + """
SELECT s.asset, s.start_t AS start_us, len(list(b.c)) AS n, round(sum(b.c), 4) AS total, round(arg_min(b.c, b.t), 4) AS oldest FROM slots s
JOIN LATERAL (SELECT c, t FROM bars WHERE bars.asset = s.asset AND bars.t <= s.start_t ORDER BY t DESC LIMIT 14) b ON true GROUP BY 1, 2""")
def _(s, d):
    r = A.asof_last_n(V.round_slots(s, d), V.bars(s, d), ["asset"], 14, left_ts="start_ts", bar_ts="ts", value="c", out="closes",
                      block=512).where("closes IS NOT NULL")
    return r.select("asset", V.us("start_ts").alias("start_us"), F.size("closes").cast("bigint").alias("n"),
                    F.round(F.aggregate("closes", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                    F.round(F.element_at("closes", 1), 4).alias("oldest"))


@add("asof_forward", V.with_views("rounds") + "SELECT asset, start_t AS start_us, open, close FROM rounds")
def _(s, d):
    return V.rounds(s, d).select("asset", V.us("start_ts").alias("start_us"), "open", "close")


@add("asof_tolerance", V.with_views("ticks slots") + """
SELECT s.asset, s.start_t AS start_us, (SELECT arg_min(price, t) FROM ticks k WHERE k.asset = s.asset
  AND k.t BETWEEN s.start_t - 300000000 AND s.start_t + 900000000) AS price FROM slots s""")
def _(s, d):
    r = A.asof_window(V.round_slots(s, d), V.ticks(s, d), ["asset"], left_ts="start_ts", tick_ts="ts", before_s=300,
                      after_s=900, take={"price": "price"})
    return r.select("asset", V.us("start_ts").alias("start_us"), "price")


@add("open_price_resolve", V.with_views("rounds") + """
SELECT asset, start_t AS start_us, CASE WHEN (start_t // 21600000000) % 3 = 0 THEN 100.5 ELSE open END AS open_price,
  CASE WHEN (start_t // 21600000000) % 3 = 0 THEN 'PM' WHEN open IS NOT NULL THEN 'CL-exact' ELSE 'not-ready' END AS open_src FROM rounds""")
def _(s, d):
    r = V.round_slots(s, d).withColumn("condition_id", F.concat("asset", V.us("start_ts").cast("string")))
    ref = r.where(F.expr(f"(unix_micros(start_ts) div {V.SIX_HOURS}) % 3 = 0")).select("condition_id", F.lit(100.5).alias("ref_price"))
    oracle = V.ticks(s, d).select("asset", F.col("ts").alias("updated_at"), "price")
    out = A.open_price_resolve(r, ref, oracle)
    return out.select("asset", V.us("start_ts").alias("start_us"), "open_price", "open_src")


@add("incremental_anti", V.with_views("slots") + """
SELECT asset, start_t AS start_us FROM slots WHERE (start_t // 21600000000) % 2 = 1""")
def _(s, d):
    r = V.round_slots(s, d).select("asset", V.us("start_ts").alias("start_us"))
    done = r.where(F.expr(f"(start_us div {V.SIX_HOURS}) % 2 = 0"))
    return r.join(done, ["asset", "start_us"], "left_anti")


@add("market_token_price", f"""
SELECT l_partkey AS condition_id, {rnd('avg(CASE WHEN l_linenumber % 2 = 0 THEN p ELSE 1 - p END)', 6)} AS up_price, count(*) AS n
FROM (SELECT l_partkey, l_linenumber, round(l_discount * 9 + 0.05, 4) AS p FROM lineitem) GROUP BY 1""")
def _(s, d):
    x = V.table(s, d, "lineitem")
    tp = x.select(F.concat("l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "u").otherwise("d")).alias("token_id"),
                  F.col("l_shipdate").alias("ts"), F.round(F.col("l_discount") * 9 + 0.05, 4).alias("price"))
    r = V.table(s, d, "part").select(F.col("p_partkey").alias("condition_id"),
                                     F.array(F.concat("p_partkey", F.lit("u")), F.concat("p_partkey", F.lit("d"))).alias("tokens"))
    return A.market_token_price(tp, r).groupBy("condition_id").agg(round_to(F.avg("up_price"), 6).alias("up_price"), F.count("*").alias("n"))
