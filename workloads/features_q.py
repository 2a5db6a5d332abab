"""Bar and tick features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marketlens.functions.base import round_to
from marketlens.operators import features as X

from . import views as V
from .util import Registry, cdf_sql, rnd

REGISTERED = Registry()
add = REGISTERED.add

TM = 252 * 24 * 60
BLOCK = 256  # small enough that block borders occur at every scale factor
W = "OVER (PARTITION BY asset ORDER BY t"
_RETS = """rets AS (SELECT *, (c - lag(c) OVER p) / lag(c) OVER p AS r, ln(c / lag(c) OVER p) AS lr, lag(c) OVER p AS pc,
    ln(c / lag(c, 5) OVER p) AS lr5 FROM bars WINDOW p AS (PARTITION BY asset ORDER BY t))"""


def frame(s, d):
    return X.BarFrame(V.bars(s, d), block=BLOCK)


def _out(df, *cols, digits=6):
    return df.select("asset", V.us("ts").alias("t_us"), *[round_to(x, digits).alias(x) for x in cols])


def _q(select: str, extra: str = "rets") -> str:
    return V.with_views("bars", _RETS) + f"SELECT asset, t AS t_us, {select} FROM {extra}"


@add("returns", _q("round(r, 6) AS ret, round(lr, 6) AS lret"))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(ret=f.simple_return(), lret=f.log_return()), "ret", "lret")


@add("rms_sigma", _q(f"round(greatest(sqrt(avg(r * r) {W} ROWS 12 PRECEDING)), 1e-8), 6) AS sigma_bar, "
                     f"round(greatest(sqrt(avg(r * r) {W} ROWS 12 PRECEDING)), 1e-8) * sqrt(3), 6) AS sigma_15m"))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(sigma_bar=f.rms_sigma(14), sigma_15m=f.rms_sigma(14) * math.sqrt(3)), "sigma_bar", "sigma_15m")


@add("annual_vol", _q(f"round(sqrt(avg(lr * lr) {W} ROWS 31 PRECEDING)) * sqrt({TM}), 5) AS vol"))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(vol=f.annual_vol(33)), "vol", digits=5)


@add("parkinson_vol", _q(f"""round(greatest(0.1, least(5.0, sqrt(avg(CASE WHEN l > 0 AND h > l THEN power(ln(h / l), 2) END)
  {W} ROWS 29 PRECEDING) / (4 * ln(2)) * {TM}))), 6) AS vol_wide, round(least(5.0, sqrt(avg(CASE WHEN l > 0 AND h > l THEN power(ln(h / l), 2) END)
  {W} ROWS 29 PRECEDING) / (4 * ln(2)) / 1000)), 6) AS vol_small""").replace(
    "round(greatest(0.1, least(5.0, sqrt(avg(CASE WHEN l > 0 AND h > l THEN power(ln(h / l), 2) END)", "round(CASE WHEN avg(CASE WHEN l > 0 AND h > l THEN 1 END) "
    + W + " ROWS 29 PRECEDING) IS NOT NULL THEN greatest(0.1, least(5.0, sqrt(avg(CASE WHEN l > 0 AND h > l THEN power(ln(h / l), 2) END)", 1).replace(
    f"/ (4 * ln(2)) * {TM}))), 6) AS vol_wide, round(least(5.0, sqrt(", f"/ (4 * ln(2)) * {TM}))) END, 6) AS vol_wide, round((sqrt(", 1))
def _(s, d):
    f = frame(s, d)
    raw = F.sqrt(F.avg(F.when((F.col("l") > 0) & (F.col("h") > F.col("l")), F.pow(F.ln(F.col("h") / F.col("l")), F.lit(2.0))))
                 .over(f.rows(29)) / (4 * math.log(2)) / 1000)
    return _out(f.with_features(vol_wide=f.parkinson_vol(30), vol_small=raw), "vol_wide", "vol_small")


@add("vol_regime_mult", _q(f"""CASE WHEN a IS NULL THEN 1.0 WHEN a < 0.40 THEN 0.7 WHEN a < 0.80 THEN 1.0 WHEN a < 1.50 THEN 1.2 ELSE 1.4 END::DOUBLE AS mult""",
     f"(SELECT *, avg(abs(r)) {W} ROWS 31 PRECEDING) * sqrt({TM}) AS a FROM rets)"))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(mult=f.vol_regime_mult()), "mult")


@add("displacement", _q(f"round((c - first_value(c) {W} ROWS 12 PRECEDING)) / first_value(c) {W} ROWS 12 PRECEDING), 6) AS disp"))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(disp=f.displacement(12)), "disp")


@add("kline_trend", _q(f"""round(CASE WHEN count(*) {W} ROWS 20 PRECEDING) >= 4 THEN (c - first_value(c) {W} ROWS 20 PRECEDING))
    / first_value(c) {W} ROWS 20 PRECEDING) / (0.01 * sqrt(20 / 15.0)) ELSE 0 END, 5) AS trend20,
  round(CASE WHEN count(*) {W} ROWS 12 PRECEDING) >= 4 THEN (c - first_value(c) {W} ROWS 12 PRECEDING))
    / first_value(c) {W} ROWS 12 PRECEDING) / (0.01 * sqrt(60 / 15.0)) ELSE 0 END, 5) AS trend12"""))
def _(s, d):
    f = frame(s, d)
    return _out(f.with_features(trend20=f.kline_trend(20, 0.01, 20), trend12=f.kline_trend(12, 0.01, 60)), "trend20", "trend12", digits=5)


@add("autocorr", V.with_views("bars", _RETS, f"arr AS (SELECT asset, t, list(r) FILTER (WHERE r IS NOT NULL) {W} ROWS 30 PRECEDING) AS rs FROM rets)",
     "mu AS (SELECT *, list_avg(rs) AS m, len(rs) AS n FROM arr)") + """
SELECT asset, t AS t_us, round(CASE WHEN n >= 4 AND list_sum(list_transform(rs, lambda x: (x - m) * (x - m))) > 0 THEN
  list_sum(list_transform(range(2, n + 1), lambda i: (rs[i] - m) * (rs[i - 1] - m))) / list_sum(list_transform(rs, lambda x: (x - m) * (x - m)))
  ELSE 0.0 END, 6) AS ac FROM mu""")
def _(s, d):
    f = frame(s, d).with_pair_products()
    return _out(f.with_features(ac=f.autocorr(32)).drop("_rr"), "ac")


@add("variance_ratio", V.with_views("bars", _RETS, f"""arr AS (SELECT asset, t, count(c) {W} ROWS 32 PRECEDING) AS n,
    list(lr) FILTER (WHERE lr IS NOT NULL) {W} ROWS 31 PRECEDING) AS rs, list(lr5) FILTER (WHERE lr5 IS NOT NULL) {W} ROWS 27 PRECEDING) AS qs FROM rets)""",
     """v AS (SELECT *, list_avg(rs) AS m FROM arr)""") + """
SELECT asset, t AS t_us, round(CASE WHEN n < 22 THEN 1.0 ELSE (list_sum(list_transform(qs, lambda x: (x - 5 * m) * (x - 5 * m))) / ((len(qs) - 1) * 5))
  / (list_sum(list_transform(rs, lambda x: (x - m) * (x - m))) / (len(rs) - 1)) END, 5) AS vr FROM v""")
def _(s, d):
    f = frame(s, d).with_q_returns(5)
    return _out(f.with_features(vr=f.variance_ratio(5)).drop("_lret5"), "vr", digits=5)


@add("taker_flow", _q(f"""CASE WHEN n < 4 THEN 0.5 ELSE round(round(tk / vol, 8), 3) END AS taker_share,
  CASE WHEN n < 4 THEN 1.0 ELSE round(round(vol / 3 / hist, 7), 2) END AS vol_ratio""",
  f"""(SELECT *, count(*) {W} ROWS 32 PRECEDING) AS n, sum(v) {W} ROWS 2 PRECEDING) AS vol, sum(taker_v) {W} ROWS 2 PRECEDING) AS tk,
    avg(v) {W} ROWS BETWEEN 32 PRECEDING AND 3 PRECEDING) AS hist FROM bars)"""))
def _(s, d):
    f = frame(s, d)
    share, ratio = f.taker_flow()
    return f.with_features(taker_share=share, vol_ratio=ratio).select("asset", V.us("ts").alias("t_us"), "taker_share", "vol_ratio")


@add("window_vwap", V.with_views("bars") + f"""
SELECT asset, t AS t_us, {rnd('tv / v_', 5)} AS vwap, {rnd('(c - tv / v_) / (tv / v_)', 6)} AS vwap_dev FROM (
  SELECT *, sum((h + l + c) / 3 * v) OVER w AS tv, sum(v) OVER w AS v_ FROM bars
  WINDOW w AS (PARTITION BY asset, t // 21600000000 ORDER BY t ROWS UNBOUNDED PRECEDING))""")
def _(s, d):
    x = X.window_vwap(V.bars(s, d), 21_600)
    return x.select("asset", V.us("ts").alias("t_us"), round_to("vwap", 5).alias("vwap"), "vwap_dev")


# Decisions come 30 minutes before and 90 minutes behind a round's start, so that some have no bar of the round yet.
@add("window_vwap_at", V.with_views("bars rounds", """q AS (SELECT asset, start_t, start_t + u.o::BIGINT * 60000000 AS dt FROM rounds, (SELECT unnest([-30, 90]) AS o) u),
n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS i FROM bars),
l AS (SELECT q.*, n.i AS i1, n.t AS t1, n.c FROM q ASOF LEFT JOIN n ON q.asset = n.asset AND q.dt >= n.t)""") + f"""
SELECT asset, start_t AS start_us, dt AS at_us, {rnd('tv / v', 5)} AS vwap, {rnd('(c - tv / v) / (tv / v)', 6)} AS vwap_dev FROM (
  SELECT l.asset, l.start_t, l.dt, l.c, sum((n.h + n.l + n.c) / 3 * n.v) AS tv, sum(n.v) AS v FROM l
  LEFT JOIN n ON n.asset = l.asset AND n.i <= l.i1 AND CASE WHEN l.t1 >= l.start_t THEN n.t >= l.start_t ELSE n.i >= l.i1 - 2 END GROUP BY ALL)""")
def _(s, d):
    q = V.rounds(s, d).select("asset", "start_ts", F.explode(F.array(F.lit(-30), F.lit(90))).alias("o"))
    q = q.select("asset", "start_ts", (F.col("start_ts") + F.make_dt_interval(mins=F.col("o"))).alias("at"))
    x = X.window_vwap_at(q, V.bars(s, d), at="at", block=BLOCK)
    return x.select("asset", V.us("start_ts").alias("start_us"), V.us("at").alias("at_us"), round_to("vwap", 5).alias("vwap"), round_to("vwap_dev", 6).alias("vwap_dev"))


@add("smooth_ofi", V.with_views("bars") + f"""
SELECT asset, t AS t_us, {rnd(f'CASE WHEN count(x) {W} ROWS 11 PRECEDING) >= 3 THEN avg(x) {W} ROWS 11 PRECEDING) ELSE x END', 6)} AS ofi
FROM (SELECT *, (2 * taker_v - v) / v AS x FROM bars)""")
def _(s, d):
    f = X.BarFrame(V.bars(s, d).withColumn("x", (2 * F.col("taker_v") - F.col("v")) / F.col("v")), block=BLOCK)
    return _out(f.with_features(ofi=f.smooth("x")), "ofi")


@add("oscillators", _q(f"""round(CASE WHEN count(pc) {W} ROWS 13 PRECEDING) < 14 THEN 50 ELSE 100.0 * (avg(greatest(c - pc, 0)) {W} ROWS 13 PRECEDING))
    / ((avg(greatest(c - pc, 0)) {W} ROWS 13 PRECEDING)) + (avg(greatest(pc - c, 0)) {W} ROWS 13 PRECEDING))) END, 4) AS rsi,
  round(CASE WHEN count(*) {W} ROWS 13 PRECEDING) >= 14 THEN (max(h) {W} ROWS 13 PRECEDING) - c)
    / (max(h) {W} ROWS 13 PRECEDING) - min(l) {W} ROWS 13 PRECEDING)) * -100 ELSE -50 END, 4) AS williams""").replace(
      "greatest(c - pc, 0)", "CASE WHEN pc IS NOT NULL THEN greatest(c - pc, 0) END").replace("greatest(pc - c, 0)", "CASE WHEN pc IS NOT NULL THEN greatest(pc - c, 0) END"))
def _(s, d):
    f = frame(s, d).with_prev_close()
    return _out(f.with_features(rsi=f.rsi(), williams=f.williams_r()).drop("_prev_c"), "rsi", "williams", digits=4)


@add("oi_delta", _q("round(r, 6) AS delta, CASE WHEN c > o THEN CASE WHEN v > 3 THEN -1 ELSE 0 END ELSE CASE WHEN v < 3 THEN -1 ELSE 0 END END AS crowding"))
def _(s, d):
    f = frame(s, d)
    x = f.with_features(delta=f.delta("c"), crowding=X.ls_crowding(F.col("v"), F.col("c") > F.col("o"), 3.0, 3.0))
    return x.select("asset", V.us("ts").alias("t_us"), F.round("delta", 6).alias("delta"), "crowding")


@add("jump_z", V.with_views("ticks", """m AS (SELECT *, power(price / lag(price) OVER (PARTITION BY asset ORDER BY t) - 1, 2) AS m2 FROM ticks)""",
     """w AS (SELECT *, count(*) OVER r AS nr, first_value(price) OVER r AS p0, count(*) OVER b AS nb, sum(m2) OVER b AS sb, first_value(m2) OVER b AS fb
       FROM m WINDOW r AS (PARTITION BY asset ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY asset ORDER BY t RANGE BETWEEN 21600000000 PRECEDING AND 3600000001 PRECEDING))""",
     """z AS (SELECT asset, t, CASE WHEN nr >= 2 AND nb >= 5 THEN (price - p0) / p0 / sqrt(greatest(sb - coalesce(fb, 0), 0) / (nb - 1)) ELSE 0 END AS z FROM w)""") + """
SELECT asset, t AS t_us, round(z, 5) AS jump_z, CASE WHEN z > 3.5 THEN 'Up' WHEN z < -3.5 THEN 'Down' END AS jump_dir FROM z""")
def _(s, d):
    x = X.jump_z(V.ticks(s, d), recent_s=3600, base_s=21_600)
    return x.select("asset", V.us("ts").alias("t_us"), F.round("jump_z", 5).alias("jump_z"), "jump_dir")


@add("lead_signal", V.with_views("ticks", """quotes AS (SELECT asset, t,
    (SELECT arg_max(price, t) FROM ticks k WHERE k.asset = 'click' AND k.t BETWEEN x.t - 9000000000 AND x.t - 5400000000) AS pf,
    (SELECT arg_max(price, t) FROM ticks k WHERE k.asset = 'click' AND k.t BETWEEN x.t - 5400000000 AND x.t - 1800000000) AS pn
    FROM ticks x WHERE asset <> 'click')""", "z AS (SELECT asset, t, (pn - pf) / pf / (50 * sqrt(3600 / 21772800.0)) * 0.75 AS z FROM quotes)") + f"""
SELECT asset, t AS t_us, round(coalesce({cdf_sql('z')}, 0.5), 6) AS lead_p FROM z""")
def _(s, d):
    x = X.lead_signal(V.ticks(s, d), "click", 50.0, far_s=7200, near_s=3600, slack_s=1800)
    return x.select("asset", V.us("ts").alias("t_us"), F.round("lead_p", 6).alias("lead_p"))


@add("price_velocity", V.with_views("ticks") + """
SELECT x.asset, x.t AS t_us, round(coalesce(x.price - y.price, 0), 6) AS velocity
FROM (SELECT *, t - 14400000000 AS t0 FROM ticks) x ASOF LEFT JOIN ticks y ON x.asset = y.asset AND x.t0 >= y.t""")
def _(s, d):
    x = X.price_velocity(V.ticks(s, d), min_age_s=14_400)
    return x.select("asset", V.us("ts").alias("t_us"), F.round("velocity", 6).alias("velocity"))


@add("prev_round_direction", V.with_views("rounds", "l AS (SELECT *, lag(open) OVER (PARTITION BY asset ORDER BY start_t) AS po FROM rounds)") + """
SELECT asset, start_t AS start_us, round(coalesce(abs((open - po) / po), 0), 6) AS prev_move,
  CASE WHEN (open - po) / po > 0.0002 THEN 'Up' WHEN (open - po) / po < -0.0002 THEN 'Down' END AS prev_dir FROM l""")
def _(s, d):
    x = X.prev_round_direction(V.rounds(s, d), keys=("asset",), block=16)
    return x.select("asset", V.us("start_ts").alias("start_us"), F.round("prev_move", 6).alias("prev_move"), "prev_dir")


_OFI_W = "WINDOW w AS (PARTITION BY asset ORDER BY t RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)"


def _signed(s, d):
    return V.ticks(s, d).select("asset", "ts", F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                                (F.col("price") - 99.0).alias("size"))


@add("agg_ofi", V.with_views("ticks") + f"""
SELECT asset, t AS t_us, round(sum(CASE WHEN user_id % 2 = 0 THEN price - 99 ELSE 99 - price END) OVER w / sum(price - 99) OVER w, 6) AS ofi
FROM ticks {_OFI_W}""")
def _(s, d):
    x = X.agg_ofi(_signed(s, d), window_s=7200)
    return x.select("asset", V.us("ts").alias("t_us"), F.round("ofi", 6).alias("ofi"))


@add("liquidation_signal", V.with_views("ticks", f"""q AS (SELECT asset, t, coalesce(sum(CASE WHEN user_id % 2 = 0 THEN price - 99 END) OVER w, 0) AS b,
    coalesce(sum(CASE WHEN user_id % 2 <> 0 THEN price - 99 END) OVER w, 0) AS k FROM ticks {_OFI_W})""") + """
SELECT asset, t AS t_us, CASE WHEN b > 0 AND b >= k * 3 THEN 2 WHEN b > k THEN 1 ELSE 0 END AS liq_up,
  CASE WHEN k > 0 AND k >= b * 3 THEN 2 WHEN k > b THEN 1 ELSE 0 END AS liq_down FROM q""")
def _(s, d):
    x = X.liquidation_signal(_signed(s, d), window_s=7200)
    return x.select("asset", V.us("ts").alias("t_us"), "liq_up", "liq_down")
