"""Trade-result reports and risk series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import prob as P
from marketlens.functions.base import round_to
from marketlens.operators import perf as R
from marketlens.operators import smoothing as S

from . import views as V
from .scalar_q import BUCKET_SQL
from .util import Registry, pf_sql, rnd, wilson_sql

REGISTERED = Registry()
add = REGISTERED.add

O = V.RES_ORDER_SQL
WA = f"OVER (PARTITION BY asset ORDER BY {O}"
ID_SQL = "l_orderkey, l_linenumber, l_partkey, t AS t_us"
BLOCK = 1024


def _id(df, *cols):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", V.us("ts").alias("t_us"), *cols)


def r6(*names, digits=6):
    return {n: round_to(n, digits) for n in names}


@add("entry_resolve_join", V.with_views("entries resolves") + """
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.t AS t_us, CASE WHEN r.l_linenumber = 3 THEN NULL
    WHEN r.l_linenumber <= 2 THEN r.l_partkey % 18 ELSE e.score END AS score, e.open_price_source, e.chainlink_age_s
FROM resolves r LEFT JOIN entries e ON r.condition_id = e.condition_id""")
def _(s, d):
    # Lines 1-2 hold a score, line 3 holds a null one, the others have none.
    r = V.resolves(s, d).withColumn("present", F.when(F.col("l_linenumber") <= 3, F.array(F.lit("score"))).otherwise(F.array().cast("array<string>")))
    r = r.withColumn("score", F.when(F.col("l_linenumber") <= 2, F.col("score")))
    j = R.entry_resolve_join(V.entries(s, d), r, ["ts"], present="present")
    return _id(j, "score", "open_price_source", "chainlink_age_s")


def joined(s, d):
    return R.entry_resolve_join(V.entries(s, d), V.resolves(s, d).drop("score"), ["ts"])


_JOINED = """joined AS (SELECT r.* EXCLUDE (score), e.score, e.open_price_source, e.chainlink_age_s
  FROM resolves r LEFT JOIN entries e USING (condition_id))"""

_DD = f"""eq AS (SELECT *, sum(pnl) {WA} ROWS UNBOUNDED PRECEDING) AS e FROM resolves),
dd AS (SELECT *, greatest(0.0, max(e) {WA} ROWS UNBOUNDED PRECEDING)) - e AS dd, greatest(0.0, max(e) {WA} ROWS UNBOUNDED PRECEDING)) AS pk FROM eq)"""


@add("pnl_summary", V.with_views("resolves", _DD, """g AS (SELECT asset, count(*) AS trades, count(*) FILTER (WHERE won) AS wins, sum(pnl) AS total_pnl,
    avg(pnl) AS avg_pnl, avg(pnl / 1000) AS m, stddev_samp(pnl / 1000) AS sd, count(*) FILTER (WHERE pnl < 0) AS nd,
    stddev_samp(pnl / 1000) FILTER (WHERE pnl < 0) AS sdd FROM resolves GROUP BY 1)""") + f"""
SELECT g.asset, trades, wins, {rnd('total_pnl', 4)} AS total_pnl, {rnd('avg_pnl', 6)} AS avg_pnl, {rnd('wins / trades', 6)} AS win_rate,
  {rnd('m / sd * sqrt(trades)', 5)} AS sharpe, {rnd('CASE WHEN nd = 0 THEN 99 ELSE m / sdd * sqrt(trades) END', 5)} AS sortino,
  {rnd('(SELECT max(dd) FROM dd WHERE dd.asset = g.asset)', 4)} AS max_dd FROM g""")
def _(s, d):
    x = R.pnl_summary(V.resolves(s, d), ["asset"], V.RES_ORDER)
    return x.withColumns(r6("total_pnl", "max_dd", digits=4) | r6("avg_pnl", "win_rate") | r6("sharpe", "sortino", digits=5))


@add("pnl_breakdown", V.with_views("entries resolves", _JOINED, """x AS (SELECT coalesce(open_price_source, 'missing') AS src,
    CASE WHEN chainlink_age_s IS NULL THEN 'missing' WHEN chainlink_age_s <= 15 THEN '0-15s' WHEN chainlink_age_s <= 45 THEN '15-45s' WHEN chainlink_age_s <= 90 THEN '45-90s' ELSE '90s+' END AS age,
    CASE WHEN score IS NULL THEN 'missing' WHEN score < 6 THEN '<6' WHEN score < 10 THEN '6-9' WHEN score < 14 THEN '10-13' ELSE '14+' END AS sc, won, pnl FROM joined)""",
    """u AS (SELECT 'source' AS dimension, src AS bucket, won, pnl FROM x UNION ALL SELECT 'age', age, won, pnl FROM x UNION ALL SELECT 'score', sc, won, pnl FROM x)""") + f"""
SELECT dimension, bucket, count(*) AS n, count(*) FILTER (WHERE won) AS wins, {rnd('count(*) FILTER (WHERE won) / count(*)', 6)} AS win_rate, {rnd('sum(pnl)', 4)} AS pnl
FROM u GROUP BY 1, 2""")
def _(s, d):
    return R.pnl_breakdown(joined(s, d)).withColumns(r6("win_rate") | r6("pnl", digits=4))


_BUCKETS = f"""bk AS (SELECT *, {BUCKET_SQL} AS bucket FROM resolves),
stats AS (SELECT bucket, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, count(*) AS outcomes, sum(pnl) AS pnl,
    coalesce(sum(greatest(0, pnl)) FILTER (WHERE won), 0) AS gross_win, coalesce(sum(greatest(0, -pnl)) FILTER (WHERE NOT won), 0) AS gross_loss,
    count(*) AS fills, sum(slip_bps) AS slip_bps, 2 * count(*) AS n FROM bk GROUP BY 1)"""


def with_bucket(s, d):
    from marketlens.functions.normalize import bucket_key
    return V.resolves(s, d).withColumn("bucket", bucket_key("duration", "score", "entry"))


def stats(s, d):
    x = with_bucket(s, d)
    return R.bucket_stats(x, fills=x.select("bucket", "slip_bps"))


@add("bucket_stats", V.with_views("resolves", _BUCKETS) + f"""
SELECT bucket, wins, losses, outcomes, {rnd('pnl', 4)} AS pnl, {rnd('gross_win', 4)} AS gross_win, {rnd('gross_loss', 4)} AS gross_loss, fills, {rnd('slip_bps', 2)} AS slip_bps, n FROM stats""")
def _(s, d):
    return stats(s, d).withColumns(r6("pnl", "gross_win", "gross_loss", digits=4) | r6("slip_bps", digits=2))


_SNAP = f"""snap AS (SELECT sum(outcomes)::BIGINT AS outcomes, sum(gross_win) AS gross_win, sum(gross_loss) AS gross_loss,
    {pf_sql('sum(gross_win)', 'sum(gross_loss)')} AS pf, sum(pnl) / sum(outcomes) AS expectancy, sum(slip_bps) / sum(fills) AS avg_slip FROM stats)"""


@add("growth_snapshot", V.with_views("resolves", _BUCKETS, _SNAP) + f"""
SELECT outcomes, {rnd('gross_win', 4)} AS gross_win, {rnd('gross_loss', 4)} AS gross_loss, {rnd('pf', 6)} AS pf, {rnd('expectancy', 6)} AS expectancy, {rnd('avg_slip', 6)} AS avg_slip FROM snap""")
def _(s, d):
    return R.growth_snapshot(stats(s, d)).withColumns(r6("gross_win", "gross_loss", digits=4) | r6("pf", "expectancy", "avg_slip"))


_DSNAP = f"""ds AS (SELECT duration, {BUCKET_SQL} AS bucket, count(*) AS outcomes, sum(pnl) AS pnl, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gw,
    coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl, sum(slip_bps) + 150 * count(*) AS slip FROM resolves GROUP BY 1, 2),
q AS (SELECT *, {pf_sql('gw', 'gl')} AS pf, pnl / outcomes AS exp, slip / outcomes AS s, bucket LIKE '%s12+%' AS hot FROM ds),
th AS (SELECT *, greatest(-0.5, least(1.8, CASE WHEN outcomes >= 10 AND pf < 1 THEN least(1.2, (1 - pf) * 1.5) ELSE 0 END
    + CASE WHEN outcomes >= 10 AND exp < 0 THEN least(1.0, abs(exp) / 0.8) ELSE 0 END + CASE WHEN s > 220 THEN least(0.6, (s - 220) / 600) ELSE 0 END
    + CASE WHEN hot THEN 0.5 ELSE 0 END - CASE WHEN outcomes >= 12 AND pf > 1.35 AND exp > 0.30 AND s < 120 THEN 0.35 ELSE 0 END)) AS tight FROM q)"""


@add("adaptive_limits", V.with_views("resolves", _DSNAP) + f"""
SELECT bucket, {rnd('greatest(1.55, CASE WHEN duration <= 5 THEN 1.75 ELSE 1.85 END + 0.2 * tight)', 6)} AS min_payout, {rnd('greatest(0.005, 0.018 + 0.015 * tight)', 6)} AS min_ev,
  {rnd('greatest(0.33, least(0.80, CASE WHEN duration <= 5 THEN 0.54 ELSE 0.65 END - 0.06 * tight))', 6)} AS max_entry,
  {rnd('''CASE WHEN outcomes < 8 THEN 0.75 ELSE greatest(0.40, least(0.92, 0.82 - CASE WHEN pf < 1 THEN least(0.25, (1 - pf) * 0.5) ELSE 0 END
    - CASE WHEN exp < 0 THEN least(0.2, abs(exp)) ELSE 0 END - CASE WHEN s > 240 THEN least(0.1, (s - 240) / 900) ELSE 0 END
    + CASE WHEN pf > 1.4 AND exp > 0.2 AND s < 120 THEN 0.05 ELSE 0 END - CASE WHEN hot THEN 0.12 ELSE 0 END)) END''', 6)} AS shrink,
  {rnd('''greatest(0.03, least(0.08, 0.045 + CASE WHEN s > 250 THEN least(0.015, (s - 250) / 25000) ELSE 0 END
    + CASE WHEN outcomes >= 10 AND pf < 1 THEN least(0.015, (1 - pf) * 0.03) ELSE 0 END - CASE WHEN outcomes >= 10 AND pf > 1.35 AND exp > 0.2 THEN 0.008 ELSE 0 END))''', 6)} AS min_edge,
  {rnd('''CASE WHEN outcomes < 8 THEN 1.0 ELSE greatest(0.4, least(1.2, CASE WHEN outcomes >= 12 AND (pf < 0.9 OR exp < -0.25) THEN 0.45 WHEN pf < 1.05 OR exp < 0 THEN 0.7
    WHEN pf > 1.35 AND exp > 0.3 AND s < 120 THEN 1.15 ELSE 1.0 END * CASE WHEN s > 350 THEN 0.75 ELSE 1.0 END)) END''', 6)} AS size_scale
FROM th""")
def _(s, d):
    x = with_bucket(s, d).withColumn("slip_bps", F.col("slip_bps") + 150)
    b = R.bucket_stats(x, ["duration", "bucket"], fills=x.select("duration", "bucket", "slip_bps"))
    q = R.growth_snapshot(b, ["duration", "bucket"]).join(b.select("duration", "bucket", "pnl", "slip_bps", "fills"), ["duration", "bucket"])
    losses = F.when(F.col("bucket").contains("s12+"), 3).otherwise(0)
    pay, ev, cap = P.adaptive_thresholds("duration", "outcomes", "pf", "expectancy", "avg_slip", losses)
    return q.select("bucket", round_to(pay, 6).alias("min_payout"), round_to(ev, 6).alias("min_ev"), round_to(cap, 6).alias("max_entry"),
                    round_to(P.prob_shrink("outcomes", "pf", "expectancy", "avg_slip", losses), 6).alias("shrink"),
                    round_to(P.adaptive_min_edge("outcomes", "pf", "expectancy", "avg_slip"), 6).alias("min_edge"),
                    round_to(P.bucket_size_scale("outcomes", "pnl", "gross_win", "gross_loss", "fills", "slip_bps"), 6).alias("size_scale"))


@add("top_bucket", V.with_views("resolves", _BUCKETS) + f"""
SELECT bucket, fills, outcomes, {rnd('wins * 100.0 / outcomes', 6)} AS wr, {rnd(pf_sql('gross_win', 'gross_loss'), 6)} AS pf, {rnd('pnl / outcomes', 6)} AS exp, {rnd('slip_bps / fills', 6)} AS slip
FROM stats ORDER BY n DESC, bucket DESC LIMIT 1""")
def _(s, d):
    return R.top_bucket(stats(s, d)).withColumns(r6("wr", "pf", "exp", "slip"))


@add("bucket_block", V.with_views("resolves signals", _BUCKETS) + f"""
SELECT duration, bucket, CASE WHEN (duration = 5 AND outcomes >= 10 AND ((pf <= 0.9 AND wr <= 0.45) OR pnl <= -5)) OR (duration >= 15 AND outcomes >= 20 AND pf <= 0.8 AND wr <= 0.40)
  THEN 'bucket_pf_blocked' ELSE 'ok' END AS reason, count(*) AS n
FROM (SELECT g.duration, g.bucket, coalesce(outcomes, 0) AS outcomes, pnl, coalesce(wins / nullif(outcomes, 0), 0) AS wr,
  CASE WHEN gross_loss > 1e-9 THEN gross_win / gross_loss WHEN gross_win > 0 THEN 99 ELSE 0 END AS pf
  FROM (SELECT duration, {BUCKET_SQL} AS bucket FROM signals) g LEFT JOIN stats USING (bucket)) GROUP BY 1, 2, 3""")
def _(s, d):
    from marketlens.functions.gates import bucket_block_reason
    from marketlens.functions.normalize import bucket_key
    sig = V.signals(s, d).select("duration", bucket_key("duration", "score", "entry").alias("bucket"))
    j = sig.join(stats(s, d), "bucket", "left").withColumn("reason", bucket_block_reason())
    return j.groupBy("duration", "bucket", "reason").agg(F.count("*").alias("n"))


_SIDE = f"""sp AS (SELECT asset, side, count(*) AS n, coalesce(sum(pnl) FILTER (WHERE pnl >= 0), 0) AS gross_win, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gross_loss, sum(pnl) AS pnl
  FROM resolves GROUP BY 1, 2)"""


@add("side_perf", V.with_views("resolves", _SIDE) + f"""
SELECT asset, side, n, {rnd('gross_win', 4)} AS gross_win, {rnd('gross_loss', 4)} AS gross_loss, {rnd('pnl', 4)} AS pnl,
  {rnd(f"CASE WHEN n < 8 THEN 0 ELSE greatest(-0.06, least(0.06, ({pf_sql('gross_win', 'gross_loss')} - 1) * 0.02 + pnl / n / 8)) END", 6)} AS bias FROM sp""")
def _(s, d):
    return R.side_perf(V.resolves(s, d)).withColumns(r6("gross_win", "gross_loss", "pnl", digits=4) | r6("bias"))


@add("asset_quality", V.with_views("resolves", """wp AS (SELECT 'W' || wallet AS asset, side, count(*) AS n, coalesce(sum(pnl) FILTER (WHERE pnl >= 0), 0) AS gw,
    coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl, sum(pnl) AS pnl FROM resolves GROUP BY 1, 2)""",
    f"q AS (SELECT *, {pf_sql('gw', 'gl')} AS pf, pnl / n AS exp FROM wp)") + f"""
SELECT asset, side, {rnd('pf', 6)} AS pf, {rnd('exp', 6)} AS expectancy, n >= 10 AND pf <= 1.6 AND exp <= 0.9 AS blocked,
  -(CASE WHEN n >= 10 AND pf <= 1.6 AND exp <= 0.9 THEN 3 ELSE 0 END + CASE WHEN n >= 10 AND (pf < 2.0 OR exp < 1.4) THEN 2 ELSE 0 END) AS score_adj,
  {rnd('-(CASE WHEN n >= 10 AND pf <= 1.6 AND exp <= 0.9 THEN 0.015 ELSE 0 END + CASE WHEN n >= 10 AND (pf < 2.0 OR exp < 1.4) THEN 0.010 ELSE 0 END)', 4)} AS edge_adj FROM q""")
def _(s, d):
    x = V.resolves(s, d).withColumn("asset", F.concat(F.lit("W"), F.col("wallet").cast("string")))
    q = R.asset_quality(R.side_perf(x), block_pf=1.6, block_exp=0.9, min_pf=2.0, min_exp=1.4)
    return q.select("asset", "side", round_to("pf", 6).alias("pf"), round_to("expectancy", 6).alias("expectancy"), "blocked", "score_adj",
                    round_to("edge_adj", 4).alias("edge_adj"))


@add("sample_prior", V.with_views("resolves", f"""nw AS (SELECT *, row_number() OVER (PARTITION BY asset, duration, side ORDER BY t DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM resolves)""",
    """g AS (SELECT asset, duration, side, count(*) AS n, count(*) FILTER (WHERE won) AS wins, sum(pnl) AS p, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gw, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl
    FROM nw GROUP BY 1, 2, 3)""") + f"""
SELECT asset, duration, side, n, wins, {rnd('wins / n', 6)} AS wr, {rnd(wilson_sql('wins', 'n'), 6)} AS wr_lb, {rnd('p / n', 6)} AS expectancy, {rnd(pf_sql('gw', 'gl'), 6)} AS pf FROM g""")
def _(s, d):
    return R.sample_prior(V.resolves(s, d), ["asset", "duration", "side"], V.RES_ORDER).withColumns(r6("wr", "wr_lb", "expectancy", "pf"))


@add("profile_adjustments", V.with_views("resolves", f"""nw AS (SELECT *, CASE WHEN entry < 0.3 THEN 'low' WHEN entry < 0.55 THEN 'mid' ELSE 'high' END AS band,
    row_number() OVER (PARTITION BY wallet, CASE WHEN entry < 0.3 THEN 'low' WHEN entry < 0.55 THEN 'mid' ELSE 'high' END ORDER BY t DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM resolves)""",
    f"""g AS (SELECT wallet, band, count(*) AS n, {wilson_sql('count(*) FILTER (WHERE won)', 'count(*)')} AS lb, avg(pnl) AS e FROM nw GROUP BY 1, 2)""") + f"""
SELECT wallet, band, n, {rnd('CASE WHEN n >= 12 THEN greatest(-0.03, least(0.03, (lb - 0.5) * 0.5)) ELSE 0 END', 6)} AS prob_adj,
  CASE WHEN n >= 12 AND lb >= 0.54 AND e > 0 THEN 1 WHEN n >= 12 AND lb <= 0.44 AND e < 0 THEN -1 ELSE 0 END AS score_adj FROM g""")
def _(s, d):
    band = F.when(F.col("entry") < 0.3, "low").when(F.col("entry") < 0.55, "mid").otherwise("high")
    p = R.sample_prior(V.resolves(s, d).withColumn("band", band), ["wallet", "band"], V.RES_ORDER)
    return R.profile_adjustments(p).select("wallet", "band", "n", round_to("prob_adj", 6).alias("prob_adj"), "score_adj")


@add("profile_results", V.with_views("resolves", _DD) + f"""
SELECT asset AS profile, count(*) AS trades, count(*) FILTER (WHERE won) AS wins, {rnd('count(*) FILTER (WHERE won) / count(*) * 100', 2)} AS wr, {rnd('sum(pnl)', 2)} AS pnl, {rnd('max(dd)', 2)} AS max_dd
FROM dd GROUP BY 1""")
def _(s, d):
    return R.rank_profiles(R.profile_results(V.resolves(s, d).withColumnRenamed("asset", "profile"), V.RES_ORDER))


@add("roi_report", V.with_views("resolves") + f"""
SELECT year(make_timestamp(t))::BIGINT AS period, asset, count(*) AS trades, count(*) FILTER (WHERE won) AS wins, {rnd('sum(pnl)', 4)} AS pnl, {rnd('sum(pnl) / 1000 * 100', 4)} AS roi_pct,
  {rnd('sum(pnl) / count(*)', 6)} AS avg_ev, {rnd('count(*) FILTER (WHERE won) / count(*) * 100', 4)} AS win_rate FROM resolves GROUP BY 1, 2""")
def _(s, d):
    x = R.roi_report(V.resolves(s, d).withColumn("period", F.year("ts").cast("bigint")), ["period", "asset"], 1000.0)
    return x.withColumns(r6("pnl", "roi_pct", "win_rate", digits=4) | r6("avg_ev"))


@add("fill_quality", V.with_views("resolves", _BUCKETS) + f"SELECT bucket, fills, {rnd('slip_bps', 2)} AS slip_sum, {rnd('slip_bps / fills', 4)} AS avg_slip FROM stats")
def _(s, d):
    return R.fill_quality(with_bucket(s, d), ["bucket"]).withColumns(r6("slip_sum", digits=2) | r6("avg_slip", digits=4))


@add("equity_curve", V.with_views("resolves", _DD) + f"SELECT {ID_SQL}, {rnd('100 + e', 4)} AS equity, {rnd('100 + pk', 4)} AS peak, {rnd('dd', 4)} AS drawdown FROM dd")
def _(s, d):
    return _id(R.equity_curve(V.resolves(s, d), ["asset"], V.RES_ORDER, start=100.0), *[round_to(x, 4).alias(x) for x in ("equity", "peak", "drawdown")])


@add("max_drawdown", V.with_views("resolves", _DD) + f"SELECT asset, {rnd('max(dd)', 4)} AS max_dd FROM dd GROUP BY 1")
def _(s, d):
    return R.max_drawdown(V.resolves(s, d), ["asset"], V.RES_ORDER).withColumn("max_dd", round_to("max_dd", 4))


@add("drawdown_scale", V.with_views("resolves", f"""x AS (SELECT *, (l_orderkey % 5 - 2.1) * size AS p FROM resolves)""",
     f"eq AS (SELECT *, 500 + coalesce(sum(p) {WA} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM x)",
     f"pk AS (SELECT *, greatest(500.0, max(e) {WA} ROWS UNBOUNDED PRECEDING)) AS pk FROM eq)") + f"""
SELECT {ID_SQL}, CASE WHEN (pk - e) / pk < 0.10 THEN 1.0 WHEN (pk - e) / pk < 0.20 THEN 0.60 WHEN (pk - e) / pk < 0.30 THEN 0.35 ELSE 0.20 END::DOUBLE AS dd_scale FROM pk""")
def _(s, d):
    x = V.resolves(s, d).withColumn("p", (F.col("l_orderkey") % 5 - 2.1) * F.col("size"))
    return _id(R.drawdown_scales(x, ["asset"], V.RES_ORDER, start=500.0, pnl="p"), "dd_scale")


_STREAK = f"""sk AS (SELECT *, row_number() {WA}) AS i, max(CASE WHEN won THEN 1 END * 0) OVER () AS z FROM resolves),
st AS (SELECT *, i - coalesce(max(CASE WHEN won THEN i END) {WA} ROWS UNBOUNDED PRECEDING), 0) AS streak FROM sk)"""


@add("loss_streaks", V.with_views("resolves", _STREAK) + "SELECT asset, max(streak) AS max_streak, arg_max(streak, i) AS current_streak FROM st GROUP BY 1")
def _(s, d):
    return R.loss_streaks(V.resolves(s, d), ["asset"], V.RES_ORDER)


@add("booster_lock", V.with_views("resolves signals", """ad AS (SELECT asset, max(t) AS t, l_orderkey, bool_and(won) AS won FROM resolves GROUP BY asset, l_orderkey)""",
     """i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t, l_orderkey) AS i FROM ad)""",
     """s AS (SELECT *, i - coalesce(max(CASE WHEN won THEN i END) OVER (PARTITION BY asset ORDER BY i), 0) AS streak FROM i)""",
     """lastone AS (SELECT asset, t, arg_max(streak, i) AS streak FROM s GROUP BY 1, 2)""") + """
SELECT g.asset, coalesce(s.streak >= 2 AND g.t < s.t + 36 * 3600000000, false) AS locked, count(*) AS n
FROM signals g ASOF LEFT JOIN lastone s ON g.asset = s.asset AND s.t <= g.t GROUP BY 1, 2""")
def _(s, d):
    ad = V.resolves(s, d).groupBy("asset", "l_orderkey").agg(F.max("ts").alias("ts"), F.bool_and("won").alias("won"))
    x = R.booster_lock(ad, V.signals(s, d).select("asset", "ts"), ["asset"], ["ts", "l_orderkey"], k=2, lock_hours=36)
    return x.groupBy("asset", "locked").agg(F.count("*").alias("n"))


def prior(s, d):
    x = V.resolves(s, d).withColumn("pnl", F.round(F.col("pnl") - 0.9, 4))
    return R.PriorFrame(x, ["asset"], V.RES_ORDER, 20, block=BLOCK)


def _prior_sql(n: int) -> str:
    w = f"{WA} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""p{n} AS (SELECT *, count(q) {w} AS k{n}, avg(q) {w} AS e{n}, coalesce(sum(CASE WHEN q > 0 THEN q END) {w}, 0) AS gw{n},
    coalesce(sum(CASE WHEN q < 0 THEN -q END) {w}, 0) AS gl{n}, count(CASE WHEN won THEN 1 END) {w} AS w{n}, count(*) {w} AS c{n} FROM pr)"""


_PR = "pr AS (SELECT *, round(pnl - 0.9, 4) AS q FROM resolves)"


@add("rolling_bet_scale", V.with_views("resolves", _PR, _prior_sql(16)) + f"""
SELECT {ID_SQL}, CASE WHEN k16 < 8 THEN 1.0 WHEN {pf_sql('gw16', 'gl16')} >= 1.45 AND round(e16, 9) > 0.40 THEN 1.12 WHEN {pf_sql('gw16', 'gl16')} >= 1.20 AND round(e16, 9) > 0.10 THEN 1.05
  WHEN {pf_sql('gw16', 'gl16')} < 1.0 OR round(e16, 9) < 0 THEN 0.85 ELSE 1.0 END::DOUBLE AS bet_scale FROM p16""")
def _(s, d):
    f = prior(s, d)
    return _id(f.with_columns(bet_scale=f.bet_scale()), "bet_scale")


@add("recent_pf", V.with_views("resolves", _PR, _prior_sql(20)) + f"SELECT {ID_SQL}, {rnd(pf_sql('gw20', 'gl20'), 5)} AS recent_pf FROM p20")
def _(s, d):
    f = prior(s, d)
    return _id(f.with_columns(recent_pf=f.recent_pf()), round_to("recent_pf", 5).alias("recent_pf"))


@add("momentum_weight", V.with_views("resolves", _PR, _prior_sql(10)) + f"SELECT {ID_SQL}, CASE WHEN k10 >= 5 AND round(e10, 9) < 0 THEN 0.55 ELSE 0.40 END::DOUBLE AS weight FROM p10")
def _(s, d):
    f = prior(s, d)
    return _id(f.with_columns(weight=f.momentum_weight()), round_to("weight", 4).alias("weight"))


@add("rolling3_gate", V.with_views("resolves", _PR, _prior_sql(3)) + f"SELECT {ID_SQL}, CASE WHEN c3 >= 3 AND w3 < 2 THEN 2 ELSE 0 END AS score_add FROM p3")
def _(s, d):
    f = prior(s, d)
    return _id(f.with_columns(score_add=f.rolling3_score_add()), "score_add")


_Q95 = """lat AS (SELECT asset, size * 137.0 + slip_bps AS x FROM resolves),
rk AS (SELECT asset, x, row_number() OVER (PARTITION BY asset ORDER BY x) AS r, count(*) OVER (PARTITION BY asset) AS n FROM lat),
pos AS (SELECT asset, n, greatest(1, least(19 * (n + 1) // 20, n - 1)) AS lo, avg(x) AS mean FROM rk GROUP BY 1, 2)"""


@add("latency_summary", V.with_views("resolves", _Q95) + f"""
SELECT p.asset, p.n, {rnd('p.mean', 4)} AS mean, {rnd('(a.x * (20 - (19 * (p.n + 1) - lo * 20)) + b.x * (19 * (p.n + 1) - lo * 20)) / 20', 4)} AS p95,
  (a.x * (20 - (19 * (p.n + 1) - lo * 20)) + b.x * (19 * (p.n + 1) - lo * 20)) / 20 <= 800 AS ok
FROM pos p JOIN rk a ON a.asset = p.asset AND a.r = lo JOIN rk b ON b.asset = p.asset AND b.r = lo + 1""")
def _(s, d):
    x = V.resolves(s, d).select("asset", (F.col("size") * 137.0 + F.col("slip_bps")).alias("latency_ms"))
    return R.latency_summary(x, ["asset"]).withColumns(r6("mean", "p95", digits=4))


@add("settle_pnl", V.with_views("resolves") + f"""
SELECT asset, won, count(*) AS n, {rnd("sum(CASE WHEN won THEN CASE WHEN l_linenumber % 3 = 0 THEN size * 1.5 ELSE size / entry - size * 0.0156 * (1 - abs(entry - 0.5) * 2) END - size ELSE -size END)", 4)} AS pnl
FROM resolves WHERE NOT l_partkey % 10 = 0 GROUP BY 1, 2""")
def _(s, d):
    from marketlens.functions.normalize import is_bookkeeping
    r = V.resolves(s, d).withColumn("order_id", F.when(F.col("l_partkey") % 10 == 0, F.lit("sync-1")).otherwise(F.col("l_orderkey").cast("string")))
    r = r.where(~is_bookkeeping("order_id"))
    p = R.settle_pnl("won", "size", "entry", "entry", F.when(F.col("l_linenumber") % 3 == 0, F.col("size") * 1.5))
    return r.groupBy("asset", "won").agg(F.count("*").alias("n"), round_to(F.sum(p), 4).alias("pnl"))


_VAR = f"""o AS (SELECT asset, won, pnl, unnest(['balanced', 'momentum', 'empirical']) AS variant, unnest([entry, least(0.95, entry + 0.1), 0.5]) AS p FROM resolves),
vs AS (SELECT asset, variant, count(*) AS n, count(*) FILTER (WHERE won) AS wins, sum(pnl) AS pnl, avg(power(p - won::INT, 2)) AS brier,
    {wilson_sql('count(*) FILTER (WHERE won)', 'count(*)')} AS wr_lb FROM o GROUP BY 1, 2),
vc AS (SELECT *, pnl / n * 0.18 + (wr_lb - 0.5) * 0.65 - brier * 0.10 AS score FROM vs),
vw AS (SELECT *, greatest(0.02, 0.7 + score * 2.2 + 0.45 - greatest(0, 8 - n) * 0.03) AS raw FROM vc)"""


def _variants(s, d):
    m = F.create_map(F.lit("balanced"), F.col("entry"), F.lit("momentum"), F.least(F.lit(0.95), F.col("entry") + 0.1))
    return R.variant_scores(V.resolves(s, d).withColumn("variant_probs", m), by=["asset"])


@add("variant_scores", V.with_views("resolves", _VAR) + f"""
SELECT asset, variant, n, wins, {rnd('pnl', 4)} AS pnl, {rnd('brier', 6)} AS brier, {rnd('wr_lb', 6)} AS wr_lb, {rnd('score', 6)} AS score,
  {rnd('CASE WHEN sum(n) OVER (PARTITION BY asset) < 12 THEN 1 / 3.0 ELSE raw / sum(raw) OVER (PARTITION BY asset) END', 6)} AS weight FROM vw""")
def _(s, d):
    x = R.variant_weights(_variants(s, d), by=["asset"])
    return x.withColumns(r6("pnl", digits=4) | r6("brier", "wr_lb", "score", "weight"))


@add("skip_funnel", V.with_views("signals") + """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN score < 10 THEN 'score_below' WHEN payout_mult < 1.72 THEN 'payout_below' WHEN execution_ev < 0.01 THEN 'ev_below' ELSE 'ok' END AS reason FROM signals) GROUP BY 1""")
def _(s, d):
    from marketlens.functions.gates import core_gate_reason
    return R.skip_funnel(V.signals(s, d).withColumn("reason", core_gate_reason(min_score=10, min_payout=1.72, min_ev=0.01)))


# ---------------------------------------------------------------- smoothing
_SEQ = """seq AS (SELECT asset, t, price, row_number() OVER (PARTITION BY asset ORDER BY t) AS i FROM ticks)"""


@add("time_ema", "WITH RECURSIVE " + V.with_views("ticks", _SEQ)[5:].rstrip() + f""",
ema AS (SELECT asset, i, t, price AS x FROM seq WHERE i = 1 UNION ALL
  SELECT s.asset, s.i, s.t, e.x + (1 - exp(-((s.t - e.t) / 1e6) / 7200)) * (s.price - e.x) FROM ema e JOIN seq s ON s.asset = e.asset AND s.i = e.i + 1)
SELECT asset, t AS t_us, {rnd('x', 6)} AS ema FROM ema""")
def _(s, d):
    x = S.time_ema(V.ticks(s, d), 7200)
    return x.select("asset", V.us("ts").alias("t_us"), round_to("ema", 6).alias("ema"))


@add("momentum_prob", "WITH RECURSIVE " + V.with_views("ticks", _SEQ)[5:].rstrip() + f""",
ema AS (SELECT asset, i, t, price, price AS x FROM seq WHERE i = 1 UNION ALL
  SELECT s.asset, s.i, s.t, s.price, e.x + (1 - exp(-((s.t - e.t) / 1e6) / 1800)) * (s.price - e.x) FROM ema e JOIN seq s ON s.asset = e.asset AND s.i = e.i + 1),
z AS (SELECT asset, t, (price - x) / x / (60 * sqrt(1800 / 21772800.0)) AS z FROM ema)
SELECT asset, t AS t_us, round(""" + __import__("workloads.util", fromlist=["cdf_sql"]).cdf_sql("z") + """, 6) AS p_up FROM z""")
def _(s, d):
    x = S.time_ema(V.ticks(s, d), 1800)
    return x.select("asset", V.us("ts").alias("t_us"), F.round(S.momentum_prob("price", "ema", 60.0, 1800), 6).alias("p_up"))


@add("kalman_velocity", "WITH RECURSIVE " + V.with_views("ticks", _SEQ)[5:].rstrip() + f""",
k AS (SELECT asset, i, t, price AS pos, 0.0::DOUBLE AS vel, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.01::DOUBLE AS p11 FROM seq WHERE i = 1 UNION ALL
  SELECT asset, i, t, pp + a / (a + r) * (z - pp), vel + b / (a + r) * (z - pp), (1 - a / (a + r)) * a, (1 - a / (a + r)) * b, cc - b / (a + r) * b
  FROM (SELECT s.asset, s.i, s.t, s.price AS z, k.vel, k.pos + k.vel * ((s.t - k.t) / 1e6) AS pp,
      k.p00 + ((s.t - k.t) / 1e6) * k.p01 + ((s.t - k.t) / 1e6) * ((s.t - k.t) / 1e6) * k.p11 + power(0.7 * s.price / sqrt(21772800.0), 2) AS a,
      k.p01 + ((s.t - k.t) / 1e6) * k.p11 AS b, k.p11 + power(0.7 * s.price / sqrt(21772800.0), 2) * 0.01 AS cc, power(0.7 * s.price * 0.001, 2) AS r
    FROM k JOIN seq s ON s.asset = k.asset AND s.i = k.i + 1))
SELECT asset, t AS t_us, {rnd('pos', 5)} AS pos, {rnd('vel', 4)} AS vel FROM k""")
def _(s, d):
    x = S.kalman_velocity(V.ticks(s, d).withColumn("vol", F.lit(0.7)), halo=512, block=1024)
    return x.select("asset", V.us("ts").alias("t_us"), round_to("pos", 5).alias("pos"), round_to("vel", 4).alias("vel"))


_CAL_SEQ = f"""seq AS (SELECT asset, l_orderkey, l_linenumber, l_partkey, t, entry AS p, won, row_number() {WA}) AS i FROM resolves)"""


@add("calibration_emas", V.with_views("resolves", _CAL_SEQ, """lst AS (SELECT asset, list({'e': power(p - won::INT, 2), 'h': 0.6 + 0.8 * ((p >= 0.5) = won)::INT} ORDER BY i) AS xs, count(*) AS n FROM seq GROUP BY 1)""") + f"""
SELECT asset, n, {rnd("list_reduce(xs, lambda a, x: {{'e': a.e * 0.96 + x.e * 0.04, 'h': a.h * 0.97 + x.h * 0.03}}, {{'e': 0.25::DOUBLE, 'h': 1.0::DOUBLE}}).e".replace('{{', '{').replace('}}', '}'), 8)} AS cal_err_ema,
  {rnd("list_reduce(xs, lambda a, x: {{'e': a.e * 0.96 + x.e * 0.04, 'h': a.h * 0.97 + x.h * 0.03}}, {{'e': 0.25::DOUBLE, 'h': 1.0::DOUBLE}}).h".replace('{{', '{').replace('}}', '}'), 8)} AS reliability FROM lst""")
def _(s, d):
    x = S.calibration_emas(V.resolves(s, d).select("asset", *V.RES_ORDER, "entry", "won"), keys=["asset"], order=V.RES_ORDER, prob="entry")
    o = F.struct(*V.RES_ORDER)
    return x.groupBy("asset").agg(F.count("*").alias("n"), round_to(F.max_by("cal_err_ema", o), 8).alias("cal_err_ema"),
                                  round_to(F.max_by("reliability", o), 8).alias("reliability"))


@add("latency_ema", V.with_views("resolves", _CAL_SEQ.replace("entry AS p", "size * 137.0 AS p"), """lst AS (SELECT asset, list(p ORDER BY i) AS xs FROM seq GROUP BY 1)""") + f"""
SELECT asset, {rnd("list_reduce(xs, lambda a, x: a * 0.8 + x * 0.2)", 6)} AS ema FROM lst""")
def _(s, d):
    x = V.resolves(s, d).select("asset", *V.RES_ORDER, (F.col("size") * 137.0).alias("latency_ms"))
    e = S.latency_ema(x, keys=["asset"], order=V.RES_ORDER)
    return e.groupBy("asset").agg(round_to(F.max_by("ema", F.struct(*V.RES_ORDER)), 6).alias("ema"))


# Days stand for seconds here: the dates have no time of day.
_SW = """b AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'momentum' ELSE 'empirical' END AS best FROM resolves),
r AS (SELECT wallet, list({'t': t, 'b': best, 'k': l_orderkey, 'l': l_linenumber} ORDER BY t, l_orderkey, l_linenumber, l_partkey) AS xs FROM b GROUP BY 1),
w AS (SELECT wallet, list_reduce(xs, lambda a, x: CASE WHEN x.b <> a.v AND x.t - a.s >= 864000000000
    THEN {'v': x.b, 's': x.t, 'o': list_append(a.o, {'k': x.k, 'l': x.l, 'v': x.b})} ELSE {'v': a.v, 's': a.s, 'o': list_append(a.o, {'k': x.k, 'l': x.l, 'v': a.v})} END,
  {'v': 'balanced', 's': -9000000000000000::BIGINT, 'o': [{'k': 0::BIGINT, 'l': 0::INT, 'v': ''}]}).o[2:] AS os FROM r)"""


@add("variant_switch", V.with_views("resolves", _SW) + "SELECT wallet, o.k AS l_orderkey, o.l AS l_linenumber, o.v AS active FROM (SELECT wallet, unnest(os) AS o FROM w)")
def _(s, d):
    best = F.element_at(F.array(F.lit("balanced"), F.lit("momentum"), F.lit("empirical")), (F.col("l_partkey") % 3 + 1).cast("int"))
    x = V.resolves(s, d).select("wallet", *V.RES_ORDER, best.alias("best"))
    return R.variant_switch(x, ["wallet"], V.RES_ORDER, hold_s=864_000, start="balanced").select("wallet", "l_orderkey", "l_linenumber", "active")
