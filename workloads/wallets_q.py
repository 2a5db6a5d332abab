"""Wallet activity, leader and side-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import wallets as W

from . import views as V
from .util import Registry

REGISTERED = Registry()
add = REGISTERED.add

NOW = 1_706_745_600.0  # the day after the last event
OWN = 1
OWN_ORDER = ("ts", "l_orderkey", "l_linenumber")

_BUY = "type IN ('TRADE', 'BUY', 'PURCHASE') AND coalesce(side, 'BUY') = 'BUY'"
_BUY_STRICT = "type IN ('TRADE', 'BUY', 'PURCHASE') AND coalesce(side, '') = 'BUY'"


def _fold_sql(buy: str = _BUY, src: str = "activity", by: str = "", name: str = "fold") -> str:
    return f"""{name} AS (
  SELECT wallet, condition_id{by}, coalesce(sum(greatest(0, usdc_size)) FILTER (WHERE {buy}), 0) AS buy,
    coalesce(sum(greatest(0, usdc_size)) FILTER (WHERE type = 'REDEEM'), 0) AS redeem,
    coalesce(max(t / 1e6) FILTER (WHERE {buy}), 0.0) AS last_buy_s
  FROM {src} WHERE ({buy}) OR type = 'REDEEM' GROUP BY ALL)"""


def _score_sql(lag: float, min_bet: float, name: str = "scored") -> str:
    return f"""{name} AS (
  SELECT wallet, count(*) FILTER (WHERE ok) AS settled, count(*) FILTER (WHERE ok AND redeem > 0) AS wins,
    coalesce(count(*) FILTER (WHERE ok AND redeem > 0) / nullif(count(*) FILTER (WHERE ok), 0)::DOUBLE, 0.0) AS wr,
    CASE WHEN sum(buy) FILTER (WHERE ok) > 0
      THEN (sum(redeem) FILTER (WHERE ok) - sum(buy) FILTER (WHERE ok)) / sum(buy) FILTER (WHERE ok) ELSE -1.0 END AS roi
  FROM (SELECT *, buy >= {min_bet} AND {NOW} - last_buy_s >= {lag} AS ok FROM fold) GROUP BY 1)"""


@add("wallet_market_fold", V.with_views("activity", _fold_sql()) +
     "SELECT wallet, condition_id, round(buy, 4) AS buy, round(redeem, 4) AS redeem, last_buy_s FROM fold")
def _(s, d):
    f = W.wallet_market_fold(V.activity(s, d))
    return f.select("wallet", "condition_id", F.round("buy", 4).alias("buy"), F.round("redeem", 4).alias("redeem"), "last_buy_s")


def _rounded(df, *cols):
    return df.withColumns({x: F.round(x, 6) for x in cols})


@add("wallet_score", V.with_views("activity", _fold_sql(), _score_sql(1800, 5.0)) +
     "SELECT wallet, settled, wins, round(wr, 6) AS wr, round(roi, 6) AS roi FROM scored")
def _(s, d):
    f = W.wallet_market_fold(V.activity(s, d))
    return _rounded(W.wallet_score(f, NOW, lag_s=1800, min_bet=5.0), "wr", "roi")


@add("wallet_score_window", V.with_views(
    "activity", f"recent AS (SELECT * FROM activity WHERE {NOW} - t / 1e6 <= 864000)",
    _fold_sql(_BUY_STRICT, "recent"), _score_sql(1200, 1.0)) +
     """SELECT wallet, settled, wins, round(wr, 6) AS wr, round(roi, 6) AS roi,
  round(greatest(0, least(1, (wr - 0.5) / 0.3)) * 0.45 + greatest(0, least(1, (roi + 1.0) / 0.5)) * 0.35
    + least(1, ln(1 + settled) / ln(81)) * 0.10 + least(1, settled / 12.0) * 0.10, 6) AS score FROM scored""")
def _(s, d):
    x = W.wallet_score_window(V.activity(s, d), NOW, window_s=864_000)
    x = x.withColumn("score", W.rolling_score("wr", "roi", "settled", "settled", min_roi=-1.0))
    return _rounded(x, "wr", "roi", "score")


_AFFINITY = f"""own AS (
  SELECT condition_id, arg_max(outcome, (t, l_orderkey, l_linenumber)) AS own_side FROM trades
  WHERE side = 'BUY' AND outcome <> '' AND wallet = {OWN} GROUP BY 1),
peers AS (
  SELECT k.condition_id, k.wallet, k.outcome, count(*) AS n, sum(greatest(0, price * size)) AS usdc,
    k.outcome <> '' AND k.outcome = o.own_side AS same_side
  FROM trades k JOIN own o USING (condition_id) WHERE k.side = 'BUY' AND k.wallet <> {OWN} GROUP BY ALL),
affinity AS (
  SELECT wallet, sum(n)::BIGINT AS same_market_trades, sum(usdc) AS same_market_usdc,
    coalesce(sum(n) FILTER (WHERE same_side), 0)::BIGINT AS same_side,
    coalesce(sum(n) FILTER (WHERE same_side), 0) / sum(n)::DOUBLE AS same_side_ratio
  FROM peers GROUP BY 1)"""


@add("peer_trades", V.with_views("trades", _AFFINITY) +
     "SELECT condition_id, wallet, outcome, n, round(usdc, 4) AS usdc, same_side FROM peers")
def _(s, d):
    t = V.trades(s, d)
    p = W.peer_trades(t, W.own_sides(t, OWN, OWN_ORDER), OWN)
    return p.select("condition_id", "wallet", "outcome", "n", F.round("usdc", 4).alias("usdc"), "same_side")


def _affinity(s, d):
    t = V.trades(s, d)
    return W.peer_affinity(W.peer_trades(t, W.own_sides(t, OWN, OWN_ORDER), OWN))


@add("peer_affinity", V.with_views("trades", _AFFINITY) +
     """SELECT wallet, same_market_trades, round(same_market_usdc, 4) AS same_market_usdc, same_side,
  round(same_side_ratio, 6) AS same_side_ratio FROM affinity""")
def _(s, d):
    return _affinity(s, d).withColumns({"same_market_usdc": F.round("same_market_usdc", 4),
                                        "same_side_ratio": F.round("same_side_ratio", 6)})


@add("top_candidates", V.with_views("trades", _AFFINITY) +
     """SELECT wallet, same_market_trades, round(same_market_usdc, 4) AS same_market_usdc FROM affinity
ORDER BY same_market_trades DESC, round(same_market_usdc, 4) DESC, wallet LIMIT 80""")
def _(s, d):
    x = _affinity(s, d).withColumn("same_market_usdc", F.round("same_market_usdc", 4))
    return W.top_candidates(x).select("wallet", "same_market_trades", "same_market_usdc")


_LEADERS = f"""leaders AS (
  SELECT c.wallet, s.settled, s.wins, s.wr, s.roi, c.same_side_ratio, c.same_market_trades, c.same_market_usdc,
    round(greatest(0, least(1, (wr - 0.45) / 0.20)) * 0.45 + greatest(0, least(1, (roi + 0.20) / 0.60)) * 0.25
      + greatest(0, least(1, (same_side_ratio - 0.45) / 0.25)) * 0.20
      + greatest(0, least(1, ln(1 + settled) / ln(61))) * 0.10, 9) AS score
  FROM affinity c JOIN scored s USING (wallet) WHERE s.settled >= 8 AND s.roi >= -1
  ORDER BY score DESC, wallet LIMIT 18)"""
_LEADER_VIEWS = V.with_views("activity trades", _fold_sql(), _score_sql(3600, 2.0), _AFFINITY, _LEADERS)


def _leaders(s, d):
    from marketlens.plans.leaderboard import leaders
    return leaders(V.trades(s, d), V.activity(s, d), OWN, NOW, min_roi=-1.0, order=OWN_ORDER)


@add("top_leaders", _LEADER_VIEWS + """SELECT wallet, round(score, 6) AS score, settled, wins, round(wr, 6) AS wr, round(roi, 6) AS roi,
  round(same_side_ratio, 6) AS same_side_ratio, same_market_trades, round(same_market_usdc, 2) AS same_market_usdc FROM leaders""")
def _(s, d):
    x = _rounded(_leaders(s, d), "score", "wr", "roi", "same_side_ratio")
    return x.withColumn("same_market_usdc", F.round("same_market_usdc", 2)).select(
        "wallet", "score", "settled", "wins", "wr", "roi", "same_side_ratio", "same_market_trades", "same_market_usdc")


@add("leader_composite", V.with_views("activity trades", _fold_sql(), _score_sql(1800, 5.0), _AFFINITY) + """
SELECT wallet, settled, round(greatest(0, least(1, (wr - 0.45) / 0.20)) * 0.45 + greatest(0, least(1, (roi + 0.20) / 0.60)) * 0.25
  + greatest(0, least(1, (same_side_ratio - 0.45) / 0.25)) * 0.20 + greatest(0, least(1, ln(1 + settled) / ln(61))) * 0.10, 6) AS score
FROM affinity JOIN scored USING (wallet)""")
def _(s, d):
    sc = W.wallet_score(W.wallet_market_fold(V.activity(s, d)), NOW, lag_s=1800, min_bet=5.0)
    x = _affinity(s, d).join(sc, "wallet")
    return x.select("wallet", "settled", F.round(W.leader_composite("wr", "roi", "same_side_ratio", "settled"), 6).alias("score"))


_FLOW = """weighted AS (SELECT k.*, l.score AS weight FROM trades k JOIN leaders l USING (wallet) WHERE k.side = 'BUY'),
flow AS (SELECT condition_id, coalesce(sum(weight) FILTER (WHERE outcome = 'Up'), 0) AS u,
    coalesce(sum(weight) FILTER (WHERE outcome = 'Down'), 0) AS dn FROM weighted GROUP BY 1)"""


@add("leader_trades", _LEADER_VIEWS + """SELECT wallet, count(*) AS n, round(sum(price * size), 4) AS usdc, round(sum(l.score), 6) AS weight
FROM trades k JOIN leaders l USING (wallet) WHERE k.side = 'BUY' GROUP BY 1""")
def _(s, d):
    x = W.leader_trades(V.trades(s, d), _leaders(s, d))
    return x.groupBy("wallet").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price") * F.col("size")), 4).alias("usdc"),
                                   F.round(F.sum("weight"), 6).alias("weight"))


@add("market_side_flow", _LEADER_VIEWS.rstrip() + ",\n" + _FLOW + """
SELECT condition_id, round(round(u / (u + dn), 9), 4) AS up, round(round(dn / (u + dn), 9), 4) AS down, round_even(round((u + dn) * 10, 8), 0)::BIGINT AS n
FROM flow WHERE u + dn > 0""")
def _(s, d):
    return W.market_side_flow(W.leader_trades(V.trades(s, d), _leaders(s, d)))


_OWN_FLOW = f"""weighted AS (SELECT k.*, l.score AS weight FROM trades k JOIN leaders l USING (wallet) WHERE k.side = 'BUY' AND k.wallet <> {OWN}
    AND k.condition_id IN (SELECT condition_id FROM trades WHERE wallet = {OWN} AND side = 'BUY' AND outcome <> '')),
""" + _FLOW.split("\n", 1)[1]


@add("leaderboard_job", _LEADER_VIEWS.rstrip() + ",\n" + _OWN_FLOW + """
SELECT 'leader' AS kind, wallet AS id, round(score, 6) AS a, round(wr, 6) AS b, settled AS n FROM leaders
UNION ALL SELECT 'market', condition_id, round(round(u / (u + dn), 9), 4), round(round(dn / (u + dn), 9), 4), round_even(round((u + dn) * 10, 8), 0)::BIGINT
FROM flow WHERE u + dn > 0""")
def _(s, d):
    from marketlens.plans.leaderboard import build_leaderboard
    lead, flow = build_leaderboard(V.trades(s, d), V.activity(s, d), OWN, NOW, min_roi=-1.0, order=OWN_ORDER)
    a = lead.select(F.lit("leader").alias("kind"), F.col("wallet").alias("id"), F.round("score", 6).alias("a"),
                    F.round("wr", 6).alias("b"), F.col("settled").alias("n"))
    b = flow.select(F.lit("market").alias("kind"), F.col("condition_id").alias("id"), F.col("up").alias("a"),
                    F.col("down").alias("b"), "n")
    return a.unionByName(b)


_FAMILIES = """fam AS (SELECT condition_id, list_extract(['BTC-15m', 'ETH-15m', 'SOL-15m', 'XRP-15m', 'BTC-5m'], condition_id % 6 + 1) AS family
  FROM (SELECT DISTINCT condition_id FROM activity) WHERE condition_id % 6 < 5)"""


def families(s, d):
    a = V.activity(s, d).select("condition_id").distinct().where("condition_id % 6 < 5")
    fams = F.array(*[F.lit(x) for x in ("BTC-15m", "ETH-15m", "SOL-15m", "XRP-15m", "BTC-5m")])
    return a.withColumn("family", F.element_at(fams, (F.col("condition_id") % 6 + 1).cast("int")))


@add("family_join", V.with_views("activity", _FAMILIES) + """
SELECT family, type, count(*) AS n, round(sum(usdc_size), 4) AS usdc FROM activity JOIN fam USING (condition_id)
WHERE family IN ('BTC-15m', 'ETH-15m') GROUP BY 1, 2""")
def _(s, d):
    x = W.family_join(V.activity(s, d), families(s, d), ("BTC-15m", "ETH-15m"))
    return x.groupBy("family", "type").agg(F.count("*").alias("n"), F.round(F.sum("usdc_size"), 4).alias("usdc"))


@add("unknown_markets", V.with_views("activity", _FAMILIES) + "SELECT DISTINCT condition_id FROM activity WHERE condition_id NOT IN (SELECT condition_id FROM fam)")
def _(s, d):
    return W.unknown_markets(V.activity(s, d), families(s, d))


@add("wallet_family_metrics", V.with_views("activity", _FAMILIES,
     "fact AS (SELECT * FROM activity JOIN fam USING (condition_id))", _fold_sql(_BUY_STRICT, "fact", ", family")) + f"""
SELECT wallet, family, settled_all, wins_all, settled_24h, wins_24h,
  round(coalesce(wins_all / nullif(settled_all, 0)::DOUBLE, 0.0), 6) AS wr_all, round(coalesce(wins_24h / nullif(settled_24h, 0)::DOUBLE, 0.0), 6) AS wr_24h,
  round(CASE WHEN b_all > 0 THEN (r_all - b_all) / b_all ELSE -1.0 END, 6) AS roi_all,
  round(CASE WHEN b_24 > 0 THEN (r_24 - b_24) / b_24 ELSE -1.0 END, 6) AS roi_24h,
  round((greatest(0, least(1, (coalesce(wins_24h / nullif(settled_24h, 0)::DOUBLE, 0.0) - 0.5) / 0.3)) * 0.35
    + greatest(0, least(1, (CASE WHEN b_24 > 0 THEN (r_24 - b_24) / b_24 ELSE -1.0 END + 1.0) / 0.5)) * 0.30
    + least(1, ln(1 + settled_24h) / ln(41)) * 0.10) + (greatest(0, least(1, (coalesce(wins_all / nullif(settled_all, 0)::DOUBLE, 0.0) - 0.5) / 0.3)) * 0.15
    + greatest(0, least(1, (CASE WHEN b_all > 0 THEN (r_all - b_all) / b_all ELSE -1.0 END + 0.05) / 0.55)) * 0.05
    + least(1, ln(1 + settled_all) / ln(181)) * 0.05), 6) AS score
FROM (SELECT wallet, family, count(*) FILTER (WHERE ok) AS settled_all, count(*) FILTER (WHERE ok AND redeem > 0) AS wins_all,
    count(*) FILTER (WHERE ok AND day) AS settled_24h, count(*) FILTER (WHERE ok AND day AND redeem > 0) AS wins_24h,
    coalesce(sum(buy) FILTER (WHERE ok), 0) AS b_all, coalesce(sum(redeem) FILTER (WHERE ok), 0) AS r_all,
    coalesce(sum(buy) FILTER (WHERE ok AND day), 0) AS b_24, coalesce(sum(redeem) FILTER (WHERE ok AND day), 0) AS r_24
  FROM (SELECT *, buy >= 1 AND {NOW} - last_buy_s >= 1200 AS ok, {NOW} - last_buy_s <= 864000 AS day FROM fold) GROUP BY 1, 2)""")
def _(s, d):
    x = W.wallet_family_metrics(W.family_join(V.activity(s, d), families(s, d)), NOW, window_s=864_000)
    x = x.withColumn("score", W.family_score(min_roi=-1.0))
    return _rounded(x, "wr_all", "wr_24h", "roi_all", "roi_24h", "score")


@add("merge_leaders", V.with_views("activity trades", _fold_sql(), _score_sql(1800, 5.0), _AFFINITY) + """
SELECT wallet, round(greatest(coalesce(a.x, 0.0), coalesce(b.y, 0.0)), 6) AS score
FROM (SELECT wallet, wr AS x FROM scored WHERE wallet % 3 > 0) a
FULL JOIN (SELECT wallet, same_side_ratio AS y FROM affinity) b USING (wallet)""")
def _(s, d):
    live = W.wallet_score(W.wallet_market_fold(V.activity(s, d)), NOW, lag_s=1800, min_bet=5.0)
    a = live.where("wallet % 3 > 0").select("wallet", F.col("wr").alias("score"))
    b = _affinity(s, d).select("wallet", F.col("same_side_ratio").alias("score"))
    return W.merge_leaders(a, b).withColumn("score", F.round("score", 6))


@add("leader_style", V.with_views("trades", """weighted AS (SELECT *, 0.1 + (wallet % 7) / 10.0 AS weight FROM trades WHERE side = 'BUY')""",
     """pw AS (SELECT condition_id, wallet, count(*) AS k FROM weighted GROUP BY 1, 2)""",
     """agg AS (SELECT condition_id, coalesce(sum(weight) FILTER (WHERE outcome = 'Up'), 0) AS u, coalesce(sum(weight) FILTER (WHERE outcome = 'Down'), 0) AS dn,
       sum(price * weight) AS pwsum, sum(weight) AS wsum, coalesce(sum(weight) FILTER (WHERE price <= 0.30), 0) AS lo,
       coalesce(sum(weight) FILTER (WHERE price >= 0.70), 0) AS hi FROM weighted GROUP BY 1)""",
     """multi AS (SELECT condition_id, count(*) FILTER (WHERE k >= 2) / count(*)::DOUBLE AS ratio FROM pw GROUP BY 1)""") + """
SELECT condition_id, round(round(u / (u + dn), 9), 4) AS up, round(round(dn / (u + dn), 9), 4) AS down, round_even(round((u + dn) * 10, 8), 0)::BIGINT AS n,
  round(round(pwsum / wsum * 100, 6), 1) AS avg_entry_c, round(round(lo / wsum, 9), 4) AS low_c_share, round(round(hi / wsum, 9), 4) AS high_c_share,
  round(round(ratio, 9), 4) AS multibet_ratio
FROM agg JOIN multi USING (condition_id) WHERE u + dn > 0""")
def _(s, d):
    t = V.trades(s, d).where("side = 'BUY'").withColumn("weight", 0.1 + (F.col("wallet") % 7) / 10.0)
    return W.leader_style(t)


@add("bet_stats", V.with_views("activity") + """
SELECT wallet, count(*) FILTER (WHERE b) AS bets, count(*) FILTER (WHERE b AND r) AS wins FROM (
  SELECT wallet, condition_id, bool_or(type IN ('BUY', 'TRADE', 'PURCHASE')) AS b, bool_or(type = 'REDEEM') AS r
  FROM activity GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return W.bet_stats(V.activity(s, d))


@add("last5_streak", V.with_views("activity") + """
SELECT wallet, string_agg(CASE WHEN r THEN 'W' ELSE 'L' END, '' ORDER BY rn) AS streak, count(*) AS bets, count(*) FILTER (WHERE r) AS wins
FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY last_t DESC, last_e DESC) AS rn FROM (
  SELECT wallet, condition_id, bool_or(type IN ('BUY', 'TRADE', 'PURCHASE')) AS b, bool_or(type = 'REDEEM') AS r,
    max(t) AS last_t, arg_max(event_id, t) AS last_e FROM activity GROUP BY 1, 2) WHERE b) WHERE rn <= 5 GROUP BY 1""")
def _(s, d):
    return W.last5_streak(V.activity(s, d))


@add("net_holdings", V.with_views("activity") + """
SELECT condition_id, round(coalesce(sum(CASE WHEN coalesce(side, 'BUY') = 'BUY' THEN size ELSE -size END) FILTER
    (WHERE type IN ('BUY', 'TRADE', 'PURCHASE') AND outcome = 'Up' AND size > 0), 0), 4) AS net_up,
  round(coalesce(sum(CASE WHEN coalesce(side, 'BUY') = 'BUY' THEN size ELSE -size END) FILTER
    (WHERE type IN ('BUY', 'TRADE', 'PURCHASE') AND outcome = 'Down' AND size > 0), 0), 4) AS net_down,
  bool_or(type = 'REDEEM') AS redeemed FROM activity GROUP BY 1""")
def _(s, d):
    return W.net_holdings(V.activity(s, d)).withColumns({"net_up": F.round("net_up", 4), "net_down": F.round("net_down", 4)})


@add("distinct_events", V.with_views("activity") + """
SELECT wallet, type, count(*) AS n FROM (SELECT DISTINCT wallet, type, usdc_size FROM activity) GROUP BY 1, 2""")
def _(s, d):
    return V.activity(s, d).dropDuplicates(["wallet", "type", "usdc_size"]).groupBy("wallet", "type").agg(F.count("*").alias("n"))
