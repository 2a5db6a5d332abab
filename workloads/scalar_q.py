"""Row-level functions: normalisation, rounds, gates, probabilities, fees, books."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import gates as G
from marketlens.functions import normalize as N
from marketlens.functions import prob as P
from marketlens.functions import rounds as R
from marketlens.functions.base import round_to

from . import views as V
from .util import LINE_COLS, LINE_ID, Registry, cdf_sql, clamp_sql, rnd, wilson_sql

REGISTERED = Registry()
add = REGISTERED.add


@add("classify_activity", V.with_views("activity") + """
SELECT event_id,
  CASE WHEN type IN ('TRADE', 'BUY', 'PURCHASE') AND coalesce(side, 'BUY') = 'BUY' THEN 'BUY'
       WHEN type = 'REDEEM' THEN 'REDEEM' ELSE 'OTHER' END AS batch_class,
  CASE WHEN type IN ('TRADE', 'BUY', 'PURCHASE') AND coalesce(side, '') = 'BUY' THEN 'BUY'
       WHEN type = 'REDEEM' THEN 'REDEEM' ELSE 'OTHER' END AS live_class
FROM activity""")
def _(s, d):
    return V.activity(s, d).select(
        "event_id", N.classify_activity("type", "side", side_default_buy=True).alias("batch_class"),
        N.classify_activity("type", "side", side_default_buy=False).alias("live_class"))


@add("normalize_text", """
SELECT page_id, lower(trim(url)) AS wallet,
  CASE WHEN page_id % 3 = 0 THEN 'Up' WHEN page_id % 3 = 1 THEN 'Down' ELSE 'Sell' END AS side,
  epoch_us(make_timestamp((1700000000 + page_id) * 1000000)) AS t_us,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE epoch_us(make_timestamp((1700000000 + page_id) * 1000000)) END AS iso_us,
  CASE WHEN page_id % 5 = 0 THEN 0.0 ELSE page_id / 8.0 END AS num
FROM pages""")
def _(s, d):
    p = V.table(s, d, "pages")
    i = F.col("page_id")
    epoch = F.when(i % 2 == 0, (i + 1700000000) * 1000).otherwise(i + 1700000000)
    iso = F.when(i % 4 == 0, F.lit("not a date")).otherwise(
        F.date_format(F.timestamp_seconds(i + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    num = F.when(i % 5 == 0, F.lit("n/a")).otherwise((i / 8.0).cast("string"))
    from marketlens.functions.base import safe_double
    return p.select(
        "page_id", N.norm_wallet("url").alias("wallet"),
        N.outcome_side(F.when(i % 3 == 0, "up").when(i % 3 == 1, "DOWN").otherwise("yes"), F.lit("sell")).alias("side"),
        F.unix_micros(N.norm_epoch(epoch)).alias("t_us"), F.unix_micros(N.parse_iso(iso).cast("timestamp")).alias("iso_us"),
        safe_double(num).alias("num"))


@add("winner_by_payout", """
SELECT o_orderkey AS condition_id,
  CASE WHEN o_custkey % 5 > 0 AND o_custkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'Up'
       WHEN o_custkey % 5 > 0 AND o_orderkey % 2 > 0 AND o_custkey % 3 = 0 THEN 'Down' END AS winner
FROM orders""")
def _(s, d):
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("condition_id"),
                    N.winner_by_payout(F.col("o_custkey") % 5, F.col("o_custkey") % 3, F.col("o_orderkey") % 2).alias("winner"))


@add("winner_by_price", f"""
SELECT {LINE_ID}, CASE WHEN p0 > 0.9 THEN 'Up' ELSE 'Down' END AS winner, CASE WHEN p0 > p1 THEN 0 ELSE 1 END AS winner_idx,
  s.side, (s.side = CASE WHEN p0 > 0.9 THEN 'Up' ELSE 'Down' END)::BIGINT AS won
FROM (SELECT {LINE_ID}, round(l_discount * 10, 2) AS p0, round(1 - l_discount * 10, 2) AS p1 FROM lineitem) x,
  (VALUES ('Up'), ('Down')) s(side)
WHERE p0 > 0.9 OR p1 > 0.9""")
def _(s, d):
    x = V.table(s, d, "lineitem").select(*LINE_COLS, F.round(F.col("l_discount") * 10, 2).alias("p0"),
                                         F.round(1 - F.col("l_discount") * 10, 2).alias("p1"))
    w = x.withColumn("winner", N.winner_by_price("p0", "p1", F.lit("Up"), F.lit("Down"))).where("winner IS NOT NULL")
    return N.unpivot_sides(w).withColumn("winner_idx", N.winner_by_argmax("p0", "p1")).drop("p0", "p1")


_WINDOWS_SQL = f"""win AS (
  SELECT {LINE_ID}, list_extract(['btc', 'eth', 'sol', 'xrp'], l_suppkey % 4 + 1) AS asset,
    CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END::BIGINT AS duration,
    epoch_us(l_shipdate) / 1e6 + (l_partkey % 6) * 150.0 AS start_s,
    epoch_us(l_shipdate) / 1e6 + (l_partkey % 6) * 150.0 + CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END * 60.0
      + (l_quantity % 4) - 1 + l_tax AS end_s
  FROM lineitem),
exact AS (SELECT *, start_s > 0 AND abs(end_s - start_s - duration * 60.0) <= 2.5
    AND floor(start_s)::BIGINT % 60 = 0 AND floor(end_s)::BIGINT % 60 = 0
    AND floor(start_s / 60)::BIGINT % duration = 0 AND floor(end_s / 60)::BIGINT % duration = 0 AS is_exact FROM win)"""


def windows(s, d):
    x = V.table(s, d, "lineitem")
    dur = F.when(F.col("l_linenumber") % 2 == 0, 5).otherwise(15).cast("bigint")
    st = V.us("l_shipdate") / 1e6 + (F.col("l_partkey") % 6) * 150.0
    return x.select(
        *LINE_COLS, F.element_at(F.array(*[F.lit(a) for a in ("btc", "eth", "sol", "xrp")]),
                                 (F.col("l_suppkey") % 4 + 1).cast("int")).alias("asset"),
        dur.alias("duration"), st.alias("start_s"),
        (st + dur * 60.0 + F.col("l_quantity") % 4 - 1 + F.col("l_tax")).alias("end_s"))


@add("is_exact_round", "WITH " + _WINDOWS_SQL + f"SELECT {LINE_ID}, is_exact FROM exact")
def _(s, d):
    return windows(s, d).select(*LINE_COLS, R.is_exact_round("start_s", "end_s", "duration").alias("is_exact"))


@add("round_key", "WITH " + _WINDOWS_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  upper(asset) || '-' || duration || 'm-' || CASE WHEN is_exact
    THEN strftime(make_timestamp(floor(start_s)::BIGINT * 1000000), '%Y%m%dT%H%M%SZ') || '-'
      || strftime(make_timestamp(floor(end_s)::BIGINT * 1000000), '%Y%m%dT%H%M%SZ')
    ELSE 'cid' || l_orderkey::VARCHAR END AS round_key,
  upper(asset) || '-' || duration || 'm-' || CASE WHEN is_exact
    THEN strftime(make_timestamp(floor(start_s)::BIGINT * 1000000), '%Y%m%dT%H%M%SZ') || '-'
      || strftime(make_timestamp(floor(end_s)::BIGINT * 1000000), '%Y%m%dT%H%M%SZ')
    ELSE 'q:' || 'round ' || l_partkey END AS fingerprint
FROM exact""")
def _(s, d):
    q = F.concat(F.lit(" Round "), F.col("l_partkey").cast("string"))
    return windows(s, d).select(
        *LINE_COLS, R.round_key("asset", "duration", "start_s", "end_s", "l_orderkey").alias("round_key"),
        R.round_fingerprint("asset", "duration", "start_s", "end_s", q).alias("fingerprint"))


_TITLES_SQL = """titles AS (
  SELECT o_orderkey, o_orderdate::DATE AS day, (o_custkey % 96) * 15 AS m0, (o_custkey % 96) * 15 + 15 AS m1 FROM orders),
texts AS (SELECT *, (day + (m0 // 60)::INTEGER * INTERVAL 1 HOUR + (m0 % 60)::INTEGER * INTERVAL 1 MINUTE) AS l0,
    (day + ((m1 % 1440) // 60)::INTEGER * INTERVAL 1 HOUR + (m1 % 60)::INTEGER * INTERVAL 1 MINUTE) AS l1 FROM titles),
raw AS (SELECT *, l0 AT TIME ZONE 'America/New_York' AS r0, l1 AT TIME ZONE 'America/New_York' AS r1 FROM texts),
-- an hour that occurs twice means its first occurrence
zoned AS (SELECT o_orderkey,
    CASE WHEN (r0 - INTERVAL 1 HOUR) AT TIME ZONE 'America/New_York' = l0 THEN r0 - INTERVAL 1 HOUR ELSE r0 END AS z0,
    CASE WHEN (r1 - INTERVAL 1 HOUR) AT TIME ZONE 'America/New_York' = l1 THEN r1 - INTERVAL 1 HOUR ELSE r1 END AS z1 FROM raw)"""


# Series, titles and slugs that mix known and unknown ones; the texts are valid in both engines.
_SERIES = "CASE o_custkey % 10 WHEN 0 THEN 'btc-up-or-down-15m' WHEN 1 THEN 'eth-up-or-down-15m' WHEN 2 THEN 'sol-up-or-down-15m' WHEN 3 THEN 'xrp-up-or-down-15m' WHEN 4 THEN 'btc-up-or-down-5m' WHEN 5 THEN 'eth-up-or-down-5m' WHEN 6 THEN 'doge-up-or-down-5m' WHEN 7 THEN '' END"
_TITLE = ("concat(CASE o_orderkey % 6 WHEN 0 THEN 'Bitcoin' WHEN 1 THEN 'Ethereum' WHEN 2 THEN 'Solana' WHEN 3 THEN 'XRP' WHEN 4 THEN 'Dogecoin' ELSE 'will BITCOIN' END,"
          " CASE o_orderkey % 5 WHEN 0 THEN ' up or down 15m' WHEN 1 THEN ' 5m window' WHEN 2 THEN ' 15M' WHEN 3 THEN ' hourly' ELSE '' END)")
_SLUG = "concat(CASE o_custkey % 6 WHEN 0 THEN 'btc' WHEN 1 THEN 'eth' WHEN 2 THEN 'sol' WHEN 3 THEN 'xbtc' WHEN 4 THEN 'BTC' ELSE 'xrp' END, CASE o_orderkey % 3 WHEN 0 THEN '-updown-5m-' WHEN 1 THEN '-updown-15m-' ELSE '-updown-5m' END, CAST(o_orderkey AS STRING))"


@add("classify_family", f"""WITH t AS (SELECT o_orderkey, {_SERIES} AS series, lower({_TITLE}) AS q FROM orders),
known AS (SELECT * FROM (VALUES ('btc-up-or-down-15m', 'BTC', 15), ('eth-up-or-down-15m', 'ETH', 15), ('sol-up-or-down-15m', 'SOL', 15), ('xrp-up-or-down-15m', 'XRP', 15),
  ('btc-up-or-down-5m', 'BTC', 5), ('eth-up-or-down-5m', 'ETH', 5)) AS v(series, asset, minutes))
SELECT o_orderkey, coalesce(asset, CASE WHEN q LIKE '%bitcoin%' THEN 'BTC' WHEN q LIKE '%ethereum%' THEN 'ETH' WHEN q LIKE '%solana%' THEN 'SOL' WHEN q LIKE '%xrp%' THEN 'XRP' ELSE '?' END) AS asset,
  coalesce(minutes, CASE WHEN q LIKE '%15m%' THEN 15 WHEN q LIKE '%5m%' THEN 5 ELSE 0 END)::BIGINT AS minutes FROM t LEFT JOIN known ON known.series = t.series""")
def _(s, d):
    asset, minutes = N.classify_family(F.expr(_SERIES), F.expr(_TITLE))
    return V.table(s, d, "orders").select("o_orderkey", asset.alias("asset"), minutes.cast("bigint").alias("minutes"))


@add("slug_filter", f"SELECT o_orderkey, slug FROM (SELECT o_orderkey, {_SLUG} AS slug FROM orders) WHERE starts_with(slug, 'btc-updown-5m-') OR starts_with(slug, 'eth-updown-5m-')")
def _(s, d):
    return V.table(s, d, "orders").select("o_orderkey", F.expr(_SLUG).alias("slug")).where(N.slug_filter("slug"))


@add("round_bounds_from_title", "WITH " + _TITLES_SQL + """
SELECT o_orderkey, epoch_us(z0) / 1e6 AS start_s,
  CASE WHEN z1 <= z0 THEN epoch_us(z0) / 1e6 + 86400 ELSE epoch_us(z1) / 1e6 END AS end_s
FROM zoned""")
def _(s, d):
    o = V.table(s, d, "orders")
    m0 = (F.col("o_custkey") % 96) * 15
    m1 = (m0 + 15) % 1440

    def clock(m):
        h = F.expr("1") * 0 + F.floor(m / 60)
        h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
        return h12.cast("string"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(h < 12, "AM").otherwise("PM")

    a, b = clock(m0), clock(m1)
    same = a[2] == b[2]
    first = F.concat(a[0], F.lit(":"), a[1], F.when(same & (F.col("o_orderkey") % 2 == 0), "").otherwise(a[2]))
    title = F.concat(F.lit("Bitcoin Up or Down - "), F.date_format("o_orderdate", "MMMM d"), F.lit(", "), first,
                     F.lit("-"), b[0], F.lit(":"), b[1], b[2], F.lit(" ET"))
    t = o.select("o_orderkey", title.alias("title"), F.year("o_orderdate").alias("y"))
    st, en = R.bounds_from_title("title", "y")
    return t.select("o_orderkey", st.alias("start_s"), en.alias("end_s"))


@add("window_from_title", "WITH " + _TITLES_SQL + """,
titled AS (SELECT o_orderkey, epoch_us(z0) / 1e6 AS qs, CASE WHEN z1 <= z0 THEN epoch_us(z0) / 1e6 + 86400 ELSE epoch_us(z1) / 1e6 END AS qe,
  CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 15 END AS minutes FROM zoned),
judged AS (SELECT *, abs((qe - qs) - minutes * 60) <= 2.5 AND qs::BIGINT % (minutes * 60) = 0 AND qe::BIGINT % (minutes * 60) = 0 AND qe <= 8.2e8 AS use FROM titled)
SELECT o_orderkey, CASE WHEN use THEN qs ELSE o_orderkey * 7e0 END AS start_s, CASE WHEN use THEN qe ELSE o_orderkey * 7e0 + 900 END AS end_s FROM judged""")
def _(s, d):
    o = V.table(s, d, "orders")
    at = lambda m: F.to_timestamp(F.concat(F.lit("2000-01-01 "), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")))
    m0 = (F.col("o_custkey") % 96) * 15
    title = F.concat(F.lit("Ethereum Up or Down - "), F.date_format("o_orderdate", "MMMM d, "), F.date_format(at(m0), "h:mma"), F.lit("-"), F.date_format(at((m0 + 15) % 1440), "h:mma"), F.lit(" ET"))
    minutes, stored = F.when(F.col("o_orderkey") % 4 == 0, 5).otherwise(15), F.col("o_orderkey") * 7.0
    st, en = R.window_from_title(title, minutes, stored, stored + 900, F.year("o_orderdate"), expired_before_s=F.lit(8.2e8))
    return o.select("o_orderkey", st.alias("start_s"), en.alias("end_s"))


@add("round_floor", """
SELECT epoch_us(ts) // 300000000 * 300000000 AS slot5_us, epoch_us(ts) // 900000000 * 900000000 AS slot15_us,
  count(*) AS n FROM events GROUP BY 1, 2""")
def _(s, d):
    e = V.table(s, d, "events")
    return e.groupBy(N.round_floor_us(V.us("ts"), 5).alias("slot5_us"),
                     N.round_floor_us(V.us("ts"), 15).alias("slot15_us")).agg(F.count("*").alias("n"))


@add("effective_end", f"""
SELECT {LINE_ID}, CASE WHEN e > 0 THEN e WHEN st > 0 AND d > 0 THEN st + d * 60.0 WHEN p > 0 AND m > 0 THEN p + m * 60.0
  WHEN p > 0 AND d > 0 THEN p + d * 60.0 ELSE 0.0 END AS end_s
FROM (SELECT {LINE_ID}, CASE WHEN l_linenumber = 1 THEN l_orderkey * 1.0 ELSE 0 END AS e,
  CASE WHEN l_linenumber <= 2 THEN l_partkey * 1.0 ELSE 0 END AS st, (l_suppkey % 3 * 5)::DOUBLE AS d,
  CASE WHEN l_linenumber <= 6 THEN l_partkey * 2.0 ELSE 0 END AS p, (l_quantity % 3) AS m FROM lineitem)""")
def _(s, d):
    x = V.table(s, d, "lineitem")
    ln = F.col("l_linenumber")
    return x.select(*LINE_COLS, R.effective_end(
        F.when(ln == 1, F.col("l_orderkey") * 1.0).otherwise(0.0), F.when(ln <= 2, F.col("l_partkey") * 1.0).otherwise(0.0),
        F.col("l_suppkey") % 3 * 5, F.when(ln <= 6, F.col("l_partkey") * 2.0).otherwise(0.0),
        F.col("l_quantity") % 3).alias("end_s"))


@add("repair_end", f"""
SELECT {LINE_ID}, CASE WHEN e = 0 THEN now_s + d * 60.0 WHEN e <= now_s AND st > now_s THEN st
  WHEN e <= now_s AND fmod(e, 86400) < 3600 AND NOT exact THEN now_s + d * 60.0 ELSE e END AS end_s
FROM (SELECT {LINE_ID}, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE epoch_us(l_shipdate) / 1e6 + (l_partkey % 5) * 1800.0 END AS e,
  CASE WHEN l_suppkey % 4 = 0 THEN 1000000000.0 ELSE 0.0 END AS st, 915148800.0 AS now_s,
  CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END AS d, l_partkey % 3 = 0 AS exact FROM lineitem)""")
def _(s, d):
    x = V.table(s, d, "lineitem")
    e = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(V.us("l_shipdate") / 1e6 + (F.col("l_partkey") % 5) * 1800.0)
    return x.select(*LINE_COLS, R.repair_end(
        e, F.when(F.col("l_suppkey") % 4 == 0, 1e9).otherwise(0.0), F.lit(915148800.0),
        F.when(F.col("l_linenumber") % 2 == 0, 5).otherwise(15), F.col("l_partkey") % 3 == 0).alias("end_s"))


@add("decision_price", f"""
SELECT {LINE_ID}, CASE WHEN oracle > 0 AND oracle_age <= 60 THEN oracle WHEN tick > 0 AND tick_age <= 1200 THEN tick
    WHEN oracle > 0 THEN oracle WHEN tick > 0 THEN tick END AS price,
  CASE WHEN oracle > 0 AND oracle_age <= 60 THEN 'CL' WHEN tick > 0 AND tick_age <= 1200 THEN 'RTDS'
    WHEN oracle > 0 THEN 'CL-stale' WHEN tick > 0 THEN 'RTDS-stale' END AS src,
  CASE WHEN oracle > 0 AND oracle_age <= 60 THEN 0.0 WHEN oracle > 0 OR tick > 0 THEN tick_age END AS quote_age_ms
FROM (SELECT {LINE_ID}, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice END AS tick,
  round(l_extendedprice % 2400, 2) AS tick_age, CASE WHEN l_partkey % 4 = 0 THEN 0.0 ELSE l_extendedprice + 1 END AS oracle,
  (l_partkey % 120)::DOUBLE AS oracle_age FROM lineitem)""")
def _(s, d):
    x = V.table(s, d, "lineitem")
    p = R.decision_price(F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice")),
                         F.round(F.col("l_extendedprice") % 2400, 2),
                         F.when(F.col("l_partkey") % 4 == 0, 0.0).otherwise(F.col("l_extendedprice") + 1),
                         (F.col("l_partkey") % 120).cast("double"))
    return x.select(*LINE_COLS, p.alias("p")).select(*LINE_COLS, "p.*")


@add("score_age_buckets", V.with_views("entries") + """
SELECT CASE WHEN chainlink_age_s IS NULL THEN 'missing' WHEN chainlink_age_s <= 15 THEN '0-15s' WHEN chainlink_age_s <= 45 THEN '15-45s'
    WHEN chainlink_age_s <= 90 THEN '45-90s' ELSE '90s+' END AS age_bucket,
  CASE WHEN score IS NULL THEN 'missing' WHEN score < 6 THEN '<6' WHEN score < 10 THEN '6-9' WHEN score < 14 THEN '10-13' ELSE '14+' END AS score_bucket,
  count(*) AS n FROM entries GROUP BY 1, 2""")
def _(s, d):
    return V.entries(s, d).groupBy(N.age_bucket("chainlink_age_s").alias("age_bucket"),
                                   N.score_bucket("score").alias("score_bucket")).agg(F.count("*").alias("n"))


BUCKET_SQL = """duration || 'm|' || CASE WHEN score >= 12 THEN 's12+' WHEN score >= 9 THEN 's9-11' ELSE 's0-8' END || '|'
  || CASE WHEN entry < 0.30 THEN '<30c' WHEN entry <= 0.50 THEN '30-50c' ELSE '>50c' END"""


@add("bucket_key", V.with_views("signals") + f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n, round(sum(entry), 4) AS entry_sum FROM signals GROUP BY 1")
def _(s, d):
    return V.signals(s, d).groupBy(N.bucket_key("duration", "score", "entry").alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.sum("entry"), 4).alias("entry_sum"))


def _tier_sql(i: int) -> str:
    rows = []
    for lim, (hi, mid, lo) in P.ENTRY_TIERS:
        v = f"CASE WHEN score >= 12 THEN {hi[i]}::DOUBLE WHEN score >= 8 THEN {mid[i]}::DOUBLE ELSE {lo[i]}::DOUBLE END"
        rows.append(f"WHEN entry <= {lim} THEN {v}" if lim is not None else f"ELSE {v}")
    return f"CASE {' '.join(rows)} END"


@add("entry_tier", V.with_views("signals") + f"SELECT {LINE_ID}, {_tier_sql(0)} AS kelly_frac, {_tier_sql(1)} AS bankroll_pct FROM signals")
def _(s, d):
    k, b = P.entry_tier("entry", "score")
    return V.signals(s, d).select(*LINE_COLS, k.alias("kelly_frac"), b.alias("bankroll_pct"))


@add("core_gates", V.with_views("signals") + f"""
SELECT {LINE_ID}, CASE WHEN score < 10 THEN 'score_below' WHEN payout_mult < 1.72 THEN 'payout_below'
  WHEN execution_ev < 0.01 THEN 'ev_below' ELSE 'ok' END AS reason FROM signals""")
def _(s, d):
    return V.signals(s, d).select(*LINE_COLS, G.core_gate_reason(min_score=10, min_payout=1.72, min_ev=0.01).alias("reason"))


@add("decide", V.with_views("signals") + f"""
SELECT *, CASE WHEN reason = 'ok' THEN greatest(1.0, 100.0 * 0.025)::DOUBLE END AS notional_usdc FROM (
  SELECT {LINE_ID}, CASE WHEN score < 0 THEN 'score_below'
    WHEN payout_mult < CASE WHEN duration <= 5 THEN 1.75 ELSE 1.72 END THEN 'payout_below'
    WHEN execution_ev < CASE WHEN duration <= 5 THEN 0.015 ELSE 0.010 END THEN 'ev_below' ELSE 'ok' END AS reason FROM signals)""")
def _(s, d):
    return G.decide(V.signals(s, d), 100.0).select(*LINE_COLS, "reason", "notional_usdc")


@add("execution_filters", V.with_views("signals") + """
SELECT reason, count(*) AS n, sum(score)::BIGINT AS score_sum FROM (SELECT *, CASE
  WHEN mins_left <= 1.2 THEN 'mins_left'
  WHEN mins_left <= CASE WHEN duration <= 5 THEN 1.0 ELSE 3.0 END AND abs(("current" - open_price) / open_price) >= 0.001
    AND side <> CASE WHEN "current" >= open_price THEN 'Up' ELSE 'Down' END THEN 'late_lock'
  WHEN asset = 'BTC' AND duration <= 5 AND score < 9 THEN 'extra_score'
  WHEN quote_age_ms > 3600 THEN 'quote_very_stale' WHEN signal_latency_ms > 2400 THEN 'latency_extreme' ELSE 'ok' END AS reason
  FROM signals) GROUP BY 1""")
def _(s, d):
    return V.signals(s, d).groupBy(G.execution_filter_reason().alias("reason")).agg(
        F.count("*").alias("n"), F.sum("score").alias("score_sum"))


@add("consistency_gates", V.with_views("signals") + """
SELECT duration, reason, count(*) AS n FROM (SELECT duration, CASE WHEN duration < 15 THEN 'ok'
  WHEN true_prob + 1e-9 < entry * (1 + fee) + 0.01 + greatest(0, entry - 0.5) * 0.10 THEN 'ev_frontier_prob_low'
  WHEN 1 / entry + 1e-9 < 1.60 THEN 'consistency_payout_low' WHEN NOT cl_agree THEN 'consistency_cl_disagree'
  WHEN true_prob + 1e-9 < 0.55 THEN 'consistency_prob_low' WHEN execution_ev + 1e-9 < 0.015 THEN 'consistency_ev_low'
  WHEN entry > 0.60 AND NOT strong THEN 'consistency_entry_high'
  WHEN NOT lead AND NOT (pct_remaining >= 0.5 AND strong) THEN 'consistency_trail_weak' ELSE 'ok' END AS reason
  FROM (SELECT *, greatest(0.001, entry * (1 - entry) * 0.0624) AS fee,
    CASE side WHEN 'Up' THEN "current" >= open_price ELSE "current" < open_price END AS lead,
    score >= 12 AND true_prob >= 0.66 AND execution_ev >= 0.03 AND tf_votes >= 3 AND cl_agree AS strong FROM signals))
GROUP BY 1, 2""")
def _(s, d):
    x = V.signals(s, d).withColumn("fee_ratio", P.fee_ratio("entry"))
    return x.groupBy("duration", G.consistency_reason().alias("reason")).agg(F.count("*").alias("n"))


@add("lowcent_regime_gates", V.with_views("signals") + """
SELECT CASE WHEN entry <= 0.20 AND NOT is_addon AND NOT (duration >= 15 AND score >= 12 AND true_prob >= 0.40 AND execution_ev >= 0.05
    AND payout_mult >= 4.0 AND cl_agree) THEN 'lowcent_new_weak' ELSE 'ok' END AS lowcent,
  CASE WHEN entry <= 0.20 AND NOT is_addon THEN 'lowcent_requires_existing'
    WHEN entry <= 0.20 AND NOT CASE side WHEN 'Up' THEN "current" > open_price ELSE "current" < open_price END THEN 'lowcent_not_leading'
    ELSE 'ok' END AS addon_only,
  CASE WHEN duration <> 5 THEN 'duration' WHEN score NOT BETWEEN 6 AND 14 THEN 'score'
    WHEN NOT (entry >= 0.05 AND entry < CASE WHEN mins_left <= 2.0 THEN 0.30 ELSE 0.40 END) THEN 'entry' ELSE 'ok' END AS regime,
  greatest(0.0, duration * 60.0 - mins_left * 60.0) BETWEEN 60 AND 265 AS in_window,
  count(*) AS n, round(sum(greatest(0.08, least(entry, 0.30 - 1e-6))), 4) AS clipped_sum
FROM signals GROUP BY 1, 2, 3, 4""")
def _(s, d):
    ok, clipped = G.lowcent_window()
    return V.signals(s, d).groupBy(
        G.lowcent_reason().alias("lowcent"), G.lowcent_reason(only_addon=True).alias("addon_only"),
        G.regime_bucket_reason(score_min=6, score_max=14).alias("regime"), ok.alias("in_window")).agg(
        F.count("*").alias("n"), F.round(F.sum(clipped), 4).alias("clipped_sum"))


@add("high_win_gates", V.with_views("signals") + """
SELECT CASE WHEN NOT cl_agree THEN 'oracle_disagree' WHEN true_prob < CASE WHEN duration <= 5 THEN 0.58 ELSE 0.60 END THEN 'prob_low'
  WHEN edge < 0.015 THEN 'edge_low' ELSE 'ok' END AS reason, count(*) AS n FROM signals GROUP BY 1""")
def _(s, d):
    return V.signals(s, d).groupBy(G.high_win_reason().alias("reason")).agg(F.count("*").alias("n"))


@add("source_confidence", V.with_views("entries") + """
SELECT condition_id, CASE open_price_source WHEN 'PM' THEN 1.0 WHEN 'CL-exact' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence,
  CASE open_price_source WHEN 'PM' THEN 1 WHEN 'CL-exact' THEN 0 ELSE -1 END
  + CASE WHEN chainlink_age_s IS NULL THEN -1 WHEN chainlink_age_s > 45 THEN -2 ELSE 0 END AS score_adj FROM entries""")
def _(s, d):
    return V.entries(s, d).select("condition_id", R.source_confidence("open_price_source").alias("confidence"),
                                  R.source_score_adj("open_price_source", "chainlink_age_s").alias("score_adj"))


@add("side_token_remap", V.with_views("signals") + f"""
SELECT {LINE_ID}, CASE WHEN abs(entry - true_prob) >= 0.18 AND abs((1 - entry) - true_prob) + 0.05 < abs(entry - true_prob)
  THEN 'opp' ELSE 'own' END AS token FROM signals""")
def _(s, d):
    return V.signals(s, d).select(*LINE_COLS, R.side_token_remap(
        F.lit("own"), F.lit("opp"), "entry", 1 - F.col("entry"), "true_prob").alias("token"))


# ---------------------------------------------------------------- probabilities and sizes
@add("norm_cdf", f"SELECT event_id, round({cdf_sql('z')}, 6) AS p FROM (SELECT event_id, (value - 20) / 15.0 AS z FROM events)")
def _(s, d):
    return V.table(s, d, "events").select("event_id", F.round(P.norm_cdf((F.col("value") - 20) / 15.0), 6).alias("p"))


@add("prob_up", V.with_views("signals") + f"""
SELECT {LINE_ID}, round({cdf_sql('z')}, 6) AS p_up,
  round(CASE side WHEN 'Up' THEN {cdf_sql('d2')} ELSE {cdf_sql('(-d2)')} END, 6) AS p_d2,
  round(-0.5 * 0 + 0.05 + 0 * z, 2) AS zero_left
FROM (SELECT *, ln("current" / open_price) / (0.7 * sqrt(greatest(mins_left, 0.1) / 362880.0)) AS z,
  (ln("current" / open_price) - 0.5 * 0.7 * 0.7 * greatest(mins_left / 525600.0, 1e-9)) / (0.7 * sqrt(greatest(mins_left / 525600.0, 1e-9))) AS d2
  FROM signals WHERE mins_left > 0)
UNION ALL
SELECT {LINE_ID}, 0.5, round(CASE side WHEN 'Up' THEN {cdf_sql('d2')} ELSE {cdf_sql('(-d2)')} END, 6), 0.05
FROM (SELECT *, (ln("current" / open_price) - 0.245 * 1e-9) / (0.7 * sqrt(1e-9)) AS d2 FROM signals WHERE mins_left <= 0)""")
def _(s, d):
    x = V.signals(s, d)
    return x.select(*LINE_COLS, F.round(P.prob_up("current", "open_price", "mins_left", F.lit(0.7)), 6).alias("p_up"),
                    F.round(P.binary_d2_prob("current", "open_price", "mins_left", F.lit(0.7), F.col("side") == "Up"), 6).alias("p_d2"),
                    F.lit(0.05).alias("zero_left"))


@add("logit_platt_shrink", V.with_views("signals") + f"""
SELECT {LINE_ID}, round(ln(greatest(true_prob, 1e-4) / greatest(1 - true_prob, 1e-4)), 6) AS lg,
  round({clamp_sql('1 / (1 + exp(-(0.9 * ln(greatest(true_prob, 1e-4) / greatest(1 - true_prob, 1e-4)) + 0.05)))', 0.05, 0.95)}, 6) AS platt,
  round(0.5 + (true_prob - 0.5) * 0.82, 6) AS shrunk, round(1 / (1 + exp(-greatest(-6.0, least(6.0, edge * 20)))), 6) AS squash
FROM signals""")
def _(s, d):
    return V.signals(s, d).select(
        *LINE_COLS, F.round(P.logit("true_prob"), 6).alias("lg"), F.round(P.platt("true_prob", 0.9, 0.05), 6).alias("platt"),
        F.round(P.shrink("true_prob", 0.82), 6).alias("shrunk"), F.round(P.logistic(F.col("edge") * 20, 6.0), 6).alias("squash"))


@add("wilson_lb", V.with_views("resolves") + f"""
SELECT asset, side, duration, n, wins, round({wilson_sql('wins', 'n')}, 6) AS lb FROM (
  SELECT asset, side, duration, count(*) AS n, count(*) FILTER (WHERE won) AS wins FROM resolves GROUP BY 1, 2, 3)""")
def _(s, d):
    g = V.resolves(s, d).groupBy("asset", "side", "duration").agg(F.count("*").alias("n"), F.count_if("won").alias("wins"))
    return g.withColumn("lb", F.round(P.wilson_lb("wins", "n"), 6))


@add("kelly_size", V.with_views("signals") + f"""
SELECT {LINE_ID}, round(greatest(0.0, least(100.0 * 0.35, 100.0 * greatest(0.0,
  (true_prob * (1 / entry - 1) - (1 - true_prob)) / (1 / entry - 1)) * {_tier_sql(0)})), 2) AS size FROM signals""")
def _(s, d):
    k, _b = P.entry_tier("entry", "score")
    return V.signals(s, d).select(*LINE_COLS, P.kelly_size("true_prob", "entry", k, 100.0).alias("size"))


@add("fee_curves", V.with_views("signals") + f"""
SELECT {LINE_ID}, round(2.5 * 0.0156 * (1 - abs(entry - 0.5) * 2), 6) AS fee_stake,
  round(0.25 * power(entry * (1 - entry), 2), 6) AS fee_rate, round(greatest(0.001, entry * (1 - entry) * 0.0624), 6) AS fee_fallback
FROM signals""")
def _(s, d):
    return V.signals(s, d).select(*LINE_COLS, F.round(P.fee_stake(F.lit(2.5), "entry"), 6).alias("fee_stake"),
                                  F.round(P.fee_ratio("entry", 0.25), 6).alias("fee_rate"),
                                  F.round(P.fee_ratio("entry"), 6).alias("fee_fallback"))


@add("payout_and_ev", V.with_views("signals") + f"""
SELECT {LINE_ID}, round(1 / entry, 6) AS payout, round(true_prob / entry - 1 - 0.0156, 6) AS ev, round(true_prob - entry, 6) AS edge,
  round(true_prob / (1 + 0.0156 + 0.018), 6) AS cap, round(entry * 1.0156 + 0.01 + greatest(0, entry - 0.5) * 0.1, 6) AS frontier,
  round((true_prob - entry) / entry * 10000, 4) AS slip, round(CASE WHEN cl_agree THEN 2 * (1 / entry - 1) ELSE -2 END, 6) AS pnl,
  round(2 * (true_prob / entry - 1), 6) AS unrealised
FROM signals""")
def _(s, d):
    return V.signals(s, d).select(
        *LINE_COLS, F.round(P.payout_mult("entry"), 6).alias("payout"), F.round(P.ev_net("true_prob", "entry"), 6).alias("ev"),
        F.round(P.edge("true_prob", "entry"), 6).alias("edge"), F.round(P.model_cap("true_prob", 0.018), 6).alias("cap"),
        F.round(P.ev_frontier_prob("entry", 0.0156, 0.01, 0.1), 6).alias("frontier"),
        F.round(P.slip_bps("true_prob", "entry"), 4).alias("slip"),
        F.round(P.pnl_binary("cl_agree", F.lit(2.0), "entry"), 6).alias("pnl"),
        F.round(P.unrealised_pnl(F.lit(2.0), "entry", "true_prob"), 6).alias("unrealised"))


@add("growth_score", V.with_views("signals") + f"""
SELECT {LINE_ID}, round(true_prob / entry - 1 - 0.0156 + edge * 0.35 + (1 / entry - 1) * 0.06 + score * 0.003
  + CASE WHEN cl_agree THEN 0.02 ELSE -0.03 END + CASE WHEN quote_age_ms > 900 THEN -0.03 ELSE 0 END
  + CASE WHEN signal_latency_ms > 550 THEN -0.03 ELSE 0 END, 6) AS growth FROM signals""")
def _(s, d):
    return V.signals(s, d).select(*LINE_COLS, F.round(P.growth_score(
        "entry", "score", "edge", "true_prob", "cl_agree", "quote_age_ms", "signal_latency_ms"), 6).alias("growth"))


@add("order_size", V.with_views("signals") + f"""
SELECT {LINE_ID}, CASE WHEN floor_usdc > 8.000001 OR raw > 8.000001 THEN 0.0 ELSE shares END AS shares,
  {rnd('CASE WHEN floor_usdc > 8.000001 THEN floor_usdc ELSE raw END', 2)} AS notional
FROM (SELECT *, shares * entry AS raw FROM (SELECT *, greatest(1.0, 5.02 * entry) AS floor_usdc,
  floor(greatest(true_prob * 9 / entry, greatest(1.0, 5.02 * entry) / entry) * 100.0 + 0.999999) / 100.0 AS shares FROM signals))""")
def _(s, d):
    o = P.order_size("entry", F.col("true_prob") * 9, max_notional=8.0)
    return V.signals(s, d).select(*LINE_COLS, o.alias("o")).select(
        *LINE_COLS, F.col("o.shares").alias("shares"), round_to("o.notional", 2).alias("notional"))


@add("book_signals", V.with_views("books") + """
SELECT book_id, round((list_sum(bids[1:10]) - list_sum(asks[1:10])) / (list_sum(bids[1:10]) + list_sum(asks[1:10])), 6) AS imbalance,
  round((bw - aw) / (bw + aw), 6) AS depth_weighted, round(depth, 6) AS depth_usdc
FROM (SELECT *, list_sum(list_transform(bids[1:20], lambda x, i: x / i)) AS bw, list_sum(list_transform(asks[1:20], lambda x, i: x / i)) AS aw,
  list_sum(list_transform(asks[1:15], lambda x, i: x * (0.40 + 0.01 * (i - 1)))) AS depth FROM books)""")
def _(s, d):
    b = V.books(s, d)
    levels = F.transform("asks", lambda x, i: F.struct((F.lit(0.40) + i * 0.01).alias("price"), x.alias("size")))
    return b.select("book_id", F.round(P.book_imbalance("bids", "asks"), 6).alias("imbalance"),
                    F.round(P.book_depth_weighted("bids", "asks"), 6).alias("depth_weighted"),
                    F.round(P.book_depth_usdc(levels, 0.545), 6).alias("depth_usdc"))


@add("perp_basis", f"""
SELECT {LINE_ID}, round(CASE WHEN l_extendedprice > 0 THEN l_tax / l_extendedprice ELSE 0 END, 7) AS basis FROM lineitem""")
def _(s, d):
    return V.table(s, d, "lineitem").select(*LINE_COLS, P.perp_basis(
        F.col("l_extendedprice") + F.col("l_tax"), "l_extendedprice").alias("basis"))


@add("open_redeemable_split", V.with_views("positions") + """
SELECT wallet, count(*) FILTER (WHERE NOT redeemable) AS open_n, count(*) FILTER (WHERE redeemable) AS redeem_n,
  round(coalesce(sum(current_value) FILTER (WHERE NOT redeemable), 0), 4) AS open_value,
  round(coalesce(sum(current_value) FILTER (WHERE redeemable), 0), 4) AS redeem_value
FROM positions WHERE outcome <> '' AND current_value >= 0.01 GROUP BY 1""")
def _(s, d):
    from marketlens.operators.positions import open_redeemable_summary
    return open_redeemable_summary(V.positions(s, d), ["wallet"])
