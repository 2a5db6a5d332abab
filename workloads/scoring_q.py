"""Scoring pipeline over snapshot rows derived from every line item.

The snapshot's column texts are valid in both engines, so both read the same inputs; the steps
themselves are written twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.base import round_to
from marketlens.operators.asof import Source, asof_many
from marketlens.plans import scoring as S
from marketlens.session import tune

from . import views as V
from .util import LINE_COLS, LINE_ID, Registry, cdf_sql, rnd

REGISTERED = Registry()
add = REGISTERED.add

_PRIMES = (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131,
           137, 139, 149, 151, 157, 163, 167, 173, 179, 181, 191, 193, 197, 199, 211, 223, 227, 229, 233, 239, 241)


def _u(k: int) -> str:
    """Number in [0, 1) spread over the keys of a line item."""
    a, b, d, e = (_PRIMES[(k * m + o) % len(_PRIMES)] for m, o in ((1, 0), (3, 5), (7, 11), (11, 17)))
    return f"(((l_orderkey * {a} + l_partkey * {b} + l_suppkey * {d} + l_linenumber * {e}) % 1009) / 1009e0)"


_DUR = "CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END"
SNAPSHOT = {
    "asset": "CASE l_suppkey % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'XRP' END",
    "duration": _DUR, "up_price": f"0.05e0 + 0.9e0 * {_u(0)}", "open_price": "100e0",
    "open_src": "CASE l_suppkey % 5 WHEN 0 THEN 'CL-exact' WHEN 1 THEN 'CL-fallback' ELSE 'PM' END",
    "current": f"100e0 * (1e0 + ({_u(1)} - 0.5e0) * 0.006e0)",
    "oracle_price": f"CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 100e0 * (1e0 + ({_u(2)} - 0.5e0) * 0.006e0) END",
    "oracle_age_s": f"CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {_u(3)} * 120e0 END", "quote_age_ms": f"{_u(4)} * 1500e0",
    "mins_left": f"{_u(5)} * ({_DUR})", "pct_remaining": _u(5),
    "mom_5s": f"0.4e0 + 0.2e0 * {_u(6)}", "mom_30s": f"0.4e0 + 0.2e0 * {_u(7)}", "mom_180s": f"0.4e0 + 0.2e0 * {_u(8)}", "mom_kal": f"0.4e0 + 0.2e0 * {_u(9)}",
    "dw_ob": f"{_u(10)} * 1.2e0 - 0.6e0", "taker_ratio": f"0.3e0 + 0.4e0 * {_u(11)}", "vol_ratio": f"0.5e0 + 2e0 * {_u(12)}",
    "perp_basis": f"({_u(13)} - 0.5e0) * 0.0016e0", "funding_rate": f"({_u(14)} - 0.5e0) * 0.003e0", "vwap_dev": f"({_u(15)} - 0.5e0) * 0.005e0",
    "vol_mult": "CASE l_partkey % 4 WHEN 0 THEN 0.7e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1.2e0 ELSE 1.4e0 END", "vol": f"0.4e0 + 0.8e0 * {_u(16)}",
    "others_up": "l_orderkey % 4", "others_down": "3 - l_orderkey % 4", "lead_p": _u(17), "autocorr": f"({_u(18)} - 0.5e0) * 0.4e0",
    "vr_ratio": f"0.8e0 + 0.4e0 * {_u(19)}", "jump_dir": "CASE l_partkey % 9 WHEN 0 THEN 'Up' WHEN 1 THEN 'Down' END",
    "prev_dir": "CASE l_orderkey % 3 WHEN 0 THEN 'Up' WHEN 1 THEN 'Down' END", "prev_move": f"{_u(20)} * 0.01e0",
    "ema5": f"100e0 * (1e0 + ({_u(21)} - 0.5e0) * 0.004e0)", "ema60": f"100e0 * (1e0 + ({_u(22)} - 0.5e0) * 0.004e0)",
    "kal_vel": f"CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE ({_u(23)} - 0.5e0) * 0.0004e0 END",
    "bias_up": f"({_u(24)} - 0.5e0) * 0.1e0", "bias_down": f"({_u(25)} - 0.5e0) * 0.1e0", "shrink": f"0.6e0 + 0.3e0 * {_u(26)}",
    "flow_up": f"CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {_u(27)} END", "flow_down": f"CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 1e0 - {_u(27)} END",
    "avg_entry_c": f"CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 90e0 * {_u(28)} END", "low_c_share": _u(29), "high_c_share": f"1e0 - {_u(29)}", "multibet_ratio": _u(30),
    "arm_side": "CASE l_partkey % 17 WHEN 0 THEN 'Up' WHEN 1 THEN 'Down' END", "arm_conf": f"CASE WHEN l_partkey % 17 <= 1 THEN 0.5e0 + 0.5e0 * {_u(31)} END",
    "ask": f"CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 0.1e0 + 0.8e0 * {_u(32)} END", "bankroll": "100e0",
    "dd_scale": "CASE WHEN l_suppkey % 3 = 0 THEN 0.6e0 ELSE 1e0 END", "wr_scale": f"0.85e0 + 0.27e0 * {_u(33)}", "bucket_scale": f"0.4e0 + 0.8e0 * {_u(34)}",
    "outcomes": "CAST(l_quantity AS BIGINT)", "pf": f"0.6e0 + {_u(35)}", "expectancy": f"{_u(36)} - 0.5e0", "avg_slip": f"400e0 * {_u(37)}",
    "consec_losses": "l_orderkey % 5",
    "ws_fresh": "l_partkey % 2 = 0", "rest_fresh": "l_partkey % 4 = 1", "leader_fresh": "l_partkey % 3 > 0", "volume_ready": "l_suppkey % 3 > 0",
    "base_prob": f"0.1e0 + 0.8e0 * {_u(38)}", "analysis_quality": _u(39), "side_n": "l_partkey % 90", "side_lb": f"0.3e0 + 0.4e0 * {_u(40)}",
    "side_exp": f"{_u(41)} - 0.5e0", "bucket_n": "l_suppkey % 30", "bucket_lb": f"0.3e0 + 0.4e0 * {_u(42)}", "bucket_exp": f"{_u(43)} - 0.5e0",
    "variant": "CASE l_orderkey % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'momentum' ELSE 'empirical' END", "variant_n": "l_partkey % 60", "cal_err": f"0.15e0 + 0.3e0 * {_u(44)}",
    "w_balanced": "0.5e0", "w_momentum": "0.3e0", "w_empirical": "0.2e0", "same_side_legs": "l_orderkey % 3", "round_legs": "l_orderkey % 5",
}
_SNAP = "snap AS (SELECT " + LINE_ID + ", " + ", ".join(f'{t} AS "{n}"' for n, t in SNAPSHOT.items()) + " FROM lineitem)"


def snapshot(s, d):
    x = V.table(tune(s), d, "lineitem")
    return x.select(*LINE_COLS, *[F.expr(t).alias(n) for n, t in SNAPSHOT.items()])


# The twin's stages.
_DIR = """d0 AS (SELECT *, abs("current" - open_price) / open_price AS move_pct,
    (mom_5s > 0.53)::INT + (mom_30s > 0.53)::INT + (mom_180s > 0.53)::INT + (mom_kal > 0.53)::INT AS tfu,
    (mom_5s < 0.47)::INT + (mom_30s < 0.47)::INT + (mom_180s < 0.47)::INT + (mom_kal < 0.47)::INT AS tfd,
    CASE WHEN "current" > open_price THEN 'Up' ELSE 'Down' END AS td,
    CASE WHEN oracle_price > 0 AND abs(oracle_price - open_price) / open_price >= 0.0002 THEN CASE WHEN oracle_price > open_price THEN 'Up' ELSE 'Down' END END AS od FROM snap),
d1 AS (SELECT *, CASE WHEN move_pct >= 0.0003 THEN CASE WHEN od IS NOT NULL AND od <> td AND move_pct < 0.001 THEN NULL ELSE td END
    WHEN od IS NOT NULL THEN od WHEN tfu > tfd THEN 'Up' WHEN tfd > tfu THEN 'Down' END AS direction FROM d0),
d2 AS (SELECT *, coalesce(direction = 'Up', false) AS up, CASE WHEN direction = 'Up' THEN tfu ELSE tfd END AS tf_votes,
    CASE WHEN oracle_price > 0 THEN coalesce(direction = 'Up', false) = (oracle_price > open_price) ELSE true END AS agree_raw,
    CASE WHEN direction = 'Up' THEN dw_ob ELSE -dw_ob END AS ob_sig, CASE WHEN direction = 'Up' THEN others_up ELSE others_down END AS cross_count FROM d1)"""
_POINTS = {
    "timing": "CASE WHEN pct_remaining >= 0.85 THEN 2 WHEN pct_remaining >= 0.70 THEN 1 ELSE 0 END",
    "move": "CASE WHEN move_pct >= 0.002 THEN 3 WHEN move_pct >= 0.0012 THEN 2 WHEN move_pct >= 0.0005 THEN 1 ELSE 0 END",
    "votes": "CASE tf_votes WHEN 4 THEN 5 WHEN 3 THEN 4 WHEN 2 THEN 2 ELSE 0 END", "oracle": "CASE WHEN cl_agree THEN 1 ELSE -3 END",
    "source": "CASE open_src WHEN 'PM' THEN 1 WHEN 'CL-exact' THEN 0 ELSE -1 END + CASE WHEN oracle_age_s IS NULL THEN -1 WHEN oracle_age_s > 45 THEN -2 ELSE 0 END",
    "jump": "CASE WHEN jump_dir = direction THEN 2 ELSE 0 END",
    "book": "CASE WHEN ob_sig > 0.25 THEN 3 WHEN ob_sig > 0.10 THEN 2 WHEN ob_sig > -0.10 THEN 1 ELSE -1 END",
    "taker": "CASE WHEN CASE WHEN up THEN taker_ratio > 0.62 ELSE taker_ratio < 0.38 END THEN 3 WHEN CASE WHEN up THEN taker_ratio > 0.55 ELSE taker_ratio < 0.45 END THEN 2 WHEN abs(taker_ratio - 0.5) < 0.05 THEN 1 ELSE -1 END",
    "volume": "CASE WHEN vol_ratio > 2 THEN 2 WHEN vol_ratio > 1.3 THEN 1 ELSE 0 END",
    "basis": "CASE WHEN perp_basis * sg > 0.0005 THEN 2 WHEN perp_basis * sg > 0.0002 THEN 1 WHEN perp_basis * sg < -0.0002 THEN -1 ELSE 0 END",
    "funding": "CASE WHEN NOT up AND funding_rate > 0.0005 THEN 1 WHEN up AND funding_rate < -0.0002 THEN 1 WHEN up AND funding_rate > 0.001 THEN -1 WHEN NOT up AND funding_rate < -0.0005 THEN -1 ELSE 0 END",
    "vwap": "CASE WHEN vwap_dev * sg > 0.0015 THEN 2 WHEN vwap_dev * sg > 0.0008 THEN 1 WHEN vwap_dev * sg < -0.0015 THEN -2 WHEN vwap_dev * sg < -0.0008 THEN -1 ELSE 0 END",
    "displacement": "CASE WHEN nd > sig THEN 2 WHEN nd > sig * 0.5 THEN 1 WHEN nd < -sig THEN -2 WHEN nd < -sig * 0.5 THEN -1 ELSE 0 END",
    "cross": "CASE WHEN cross_count = 3 THEN 2 WHEN cross_count >= 2 THEN 1 ELSE 0 END",
    "lead": "CASE WHEN asset = 'BTC' THEN 0 WHEN lp > 0.60 THEN 2 WHEN lp > 0.55 THEN 1 WHEN lp < 0.40 THEN -1 ELSE 0 END",
    "continuation": "CASE WHEN prev_dir IS NULL THEN 0 WHEN prev_dir = direction THEN CASE WHEN pct_remaining > 0.85 THEN 5 WHEN pct_remaining > 0.80 THEN 4 WHEN pct_remaining > 0.70 THEN 2 ELSE 1 END ELSE -2 END",
    "regime": "CASE WHEN vr_ratio > 1.05 AND autocorr > 0.05 THEN 1 WHEN vr_ratio < 0.95 AND autocorr < -0.05 THEN -1 ELSE 0 END",
}
_SHEET = _DIR + """,
s0 AS (SELECT * EXCLUDE (agree_raw), agree_raw AS cl_agree, CASE WHEN up THEN 1e0 ELSE -1e0 END AS sg, vol * sqrt(15e0 / (252 * 390)) AS sig,
    CASE WHEN up THEN lead_p ELSE 1 - lead_p END AS lp, ("current" - open_price) / open_price * CASE WHEN up THEN 1 ELSE -1 END AS nd FROM d2),
s1 AS (SELECT *, """ + ", ".join(f"{t} AS pts_{k}" for k, t in _POINTS.items()) + """,
    CASE WHEN vr_ratio > 1.05 AND autocorr > 0.05 THEN 1.15 WHEN vr_ratio < 0.95 AND autocorr < -0.05 THEN 0.85 ELSE 1.0 END::DOUBLE AS regime_mult FROM s0),
s2 AS (SELECT *, """ + " + ".join(f"pts_{k}" for k in _POINTS) + """ AS score FROM s1)"""
_LLR = _SHEET + """,
l0 AS (SELECT *, (("current" - open_price) / open_price / sig * 1.5 + (ema5 / ema60 - 1) * 300 + coalesce(kal_vel / greatest(vol / sqrt(252 * 24 * 3600.0::DOUBLE), 1e-8) * 0.4, 0)
    + dw_ob * 2.5 + (taker_ratio - 0.5) * 5 + CASE WHEN abs(perp_basis) > 1e-7 THEN sign(perp_basis) * least(abs(perp_basis) * 1000, 1.5) ELSE 0 END
    + CASE WHEN cl_agree THEN 0.4 ELSE -1.0 END + CASE WHEN asset = 'BTC' THEN 0 ELSE (lead_p - 0.5) * 3 END) * regime_mult AS llr FROM s2),
l1 AS (SELECT *, 1 / (1 + exp(-greatest(-6e0, least(6e0, llr)))) AS pl, least(0.68, 0.58 + prev_move * 10) AS prior, coalesce(prev_dir = direction AND pct_remaining > 0.80, false) AS early FROM l0),
l2 AS (SELECT *, greatest(0.05, least(0.95, pl + bias_up)) AS u0, greatest(0.05, least(0.95, 1 - pl + bias_down)) AS dn0 FROM l1),
l3 AS (SELECT *, greatest(0.05, least(0.95, 0.5 + (CASE WHEN early AND up THEN greatest(u0, prior) WHEN early THEN 1 - greatest(dn0, prior) ELSE u0 END - 0.5) * shrink)) AS prob_up FROM l2),
l4 AS (SELECT *, 1 - prob_up AS prob_down, prob_up - up_price AS edge_up, (1 - prob_up) - (1 - up_price) AS edge_down FROM l3)"""
_SIDE = _LLR + """,
c0 AS (SELECT *, CASE WHEN move_pct >= 0.0005 THEN td ELSE direction END AS base FROM l4),
c1 AS (SELECT *, coalesce(CASE base WHEN 'Up' THEN edge_up WHEN 'Down' THEN edge_down END < -0.15, true) AS side_blocked,
    CASE WHEN prob_up >= prob_down THEN 'Up' ELSE 'Down' END AS side FROM c0),
c2 AS (SELECT *, CASE side WHEN 'Up' THEN edge_up ELSE edge_down END AS edge, CASE side WHEN 'Up' THEN prob_up ELSE prob_down END AS true_prob FROM c1)"""
_COPY = _SIDE + """,
k0 AS (SELECT *, coalesce(round(CASE side WHEN 'Up' THEN flow_up - flow_down ELSE flow_down - flow_up END, 9), 0) AS copy_net,
    CASE side WHEN 'Up' THEN up_price ELSE 1 - up_price END AS paid, coalesce(arm_conf >= 0.58, false) AS arm_active FROM c2),
k1 AS (SELECT *, round_even(round(greatest(-2e0, least(2e0, copy_net * 2)), 9), 0)::INT AS copy_adj, CASE WHEN flow_up IS NOT NULL AND avg_entry_c > 0 AND high_c_share >= 0.60 AND multibet_ratio >= 0.30 THEN 1
    WHEN flow_up IS NOT NULL AND avg_entry_c > 0 AND low_c_share >= 0.60 AND paid > 0.55 THEN -1 ELSE 0 END AS style_adj FROM k0),
k2 AS (SELECT * EXCLUDE (score, edge, side), score + copy_adj + style_adj + CASE WHEN arm_active THEN 2 ELSE 0 END AS score,
    edge + copy_net * 0.01 + style_adj * 0.005 + CASE WHEN arm_active THEN greatest(0, arm_conf - 0.5) * 0.05 ELSE 0 END AS edge,
    CASE WHEN arm_active AND arm_side IS NOT NULL THEN arm_side ELSE side END AS side FROM k1),
k3 AS (SELECT * EXCLUDE (true_prob, edge), greatest(true_prob, CASE side WHEN 'Up' THEN prob_up ELSE prob_down END) AS true_prob,
    greatest(edge, CASE side WHEN 'Up' THEN edge_up ELSE edge_down END) AS edge, CASE side WHEN 'Up' THEN up_price ELSE 1 - up_price END AS entry_ref FROM k2)"""
_TIGHT = """greatest(-0.5, least(1.8, CASE WHEN outcomes >= 10 AND pf < 1 THEN least(1.2, (1 - pf) * 1.5) ELSE 0 END + CASE WHEN outcomes >= 10 AND expectancy < 0 THEN least(1.0, abs(expectancy) / 0.8) ELSE 0 END
  + CASE WHEN avg_slip > 220 THEN least(0.6, (avg_slip - 220) / 600) ELSE 0 END + CASE WHEN consec_losses >= 2 THEN least(1.0, (consec_losses - 1) * 0.25) ELSE 0 END
  - CASE WHEN outcomes >= 12 AND pf > 1.35 AND expectancy > 0.30 AND avg_slip < 120 THEN 0.35 ELSE 0 END))"""


def _tiers(i: int) -> str:
    from marketlens.functions.prob import ENTRY_TIERS
    out = []
    for lim, (hi, mid, lo) in ENTRY_TIERS:
        v = f"CASE WHEN score >= 12 THEN {hi[i]}e0 WHEN score >= 8 THEN {mid[i]}e0 ELSE {lo[i]}e0 END"
        out.append(f"WHEN entry <= {lim} THEN {v}" if lim is not None else f"ELSE {v}")
    return f"CASE {' '.join(out)} END"


_SIZE = _COPY + f""",
e0 AS (SELECT *, {_TIGHT} AS tight, duration <= 5 AS five, coalesce(ask, entry_ref) AS live FROM k3),
e1 AS (SELECT *, CASE WHEN five THEN 0.35 ELSE 0.01 END AS min_entry, greatest(1.55, CASE WHEN five THEN 1.75 ELSE 1.85 END + 0.2 * tight) AS pay_req, greatest(0.005, 0.018 + 0.015 * tight) AS ev_req,
    greatest(0, CASE WHEN five THEN 8 ELSE 6 END - CASE WHEN arm_active THEN 2 ELSE 0 END) AS need,
    least(least(0.97, 0.58 + 0.015 + CASE WHEN score >= 12 THEN 0.02 WHEN score >= 9 THEN 0.01 ELSE 0 END), CASE WHEN five THEN 0.52 ELSE 0.56 END) AS hi0 FROM e0),
e2 AS (SELECT *, least(CASE WHEN score >= 9 THEN greatest(hi0, least(0.85, true_prob / (1 + 0.0156 + 0.018))) ELSE hi0 END, greatest(0.33, least(0.80, CASE WHEN five THEN 0.54 ELSE 0.65 END - 0.06 * tight))) AS max_entry FROM e1),
e3 AS (SELECT *, CASE WHEN live BETWEEN min_entry AND max_entry THEN live WHEN pct_remaining >= 0.25 THEN max_entry END AS entry,
    NOT (live BETWEEN min_entry AND max_entry) AND pct_remaining >= 0.25 AS use_limit FROM e2),
e4 AS (SELECT *, true_prob / entry - 1 - 0.0156 AS ev, {_tiers(0)} AS kf, {_tiers(1)} AS bp FROM e3),
e5 AS (SELECT *, greatest(0.5, least(least(100e0, bankroll * bp), greatest(0.5, bankroll * 0.10), bankroll * 0.35)) AS hard_cap,
    {rnd('greatest(0, least(bankroll * 0.35, bankroll * greatest(0, (true_prob * (1 / entry - 1) - (1 - true_prob)) / (1 / entry - 1)) * kf * dd_scale))', 2)} * vol_mult * wr_scale
    * CASE WHEN NOT cl_agree AND coalesce(oracle_age_s <= 45, false) THEN 0.6 WHEN NOT cl_agree THEN 0.8 ELSE 1.0 END * bucket_scale AS raw FROM e4),
e6 AS (SELECT *, {rnd('least(hard_cap, raw)', 2)} AS model, least(hard_cap, greatest(1.5, bankroll * 0.01)) AS floor_ FROM e5),
e7 AS (SELECT *, CASE WHEN score < need THEN 'score_below' WHEN entry IS NULL THEN 'entry_outside' WHEN 1 / entry < pay_req THEN 'payout_below' WHEN ev < ev_req THEN 'ev_below'
    WHEN model < floor_ AND NOT (score >= 12 AND true_prob >= 0.62 AND edge >= 0.03) THEN 'size_too_small' ELSE 'ok' END AS size_reason FROM e6),
e8 AS (SELECT *, CASE WHEN size_reason = 'ok' THEN greatest(0.5, least(hard_cap, CASE WHEN model < floor_ THEN {rnd('floor_', 2)} ELSE model END)) END AS size,
    (NOT use_limit AND score >= 12 AND coalesce((tf_votes >= 3 AND ob_sig > 0.10 AND move_pct > 0.0015) OR (prev_dir = direction AND pct_remaining > 0.85), false)) OR arm_active AS force_taker FROM e7)"""


def _sql(stages: str, select: str) -> str:
    return f"WITH {_SNAP},\n{stages}\n{select}"


def directed(s, d):
    return S.direction(snapshot(s, d))


def sheet(s, d):
    return S.score_sheet(directed(s, d))


def posterior(s, d):
    return S.llr_posterior(sheet(s, d))


def copied(s, d):
    return S.copy_adjust(S.choose_side(posterior(s, d)))


def sized(s, d):
    return S.entry_and_size(copied(s, d))


@add("direction", _sql(_DIR, f"SELECT {LINE_ID}, direction, tf_votes, agree_raw AS cl_agree FROM d2"))
def _(s, d):
    return directed(s, d).select(*LINE_COLS, "direction", "tf_votes", "cl_agree")


@add("score_sheet", _sql(_SHEET, f"SELECT {LINE_ID}, {', '.join('pts_' + k for k in _POINTS)}, score FROM s2"))
def _(s, d):
    return sheet(s, d).select(*LINE_COLS, *[f"pts_{k}" for k in S.SHEET], "score")


@add("llr_posterior", _sql(_LLR, f"SELECT {LINE_ID}, {rnd('llr', 6)} AS llr, {rnd('prob_up', 6)} AS prob_up FROM l4"))
def _(s, d):
    return posterior(s, d).select(*LINE_COLS, round_to("llr", 6).alias("llr"), round_to("prob_up", 6).alias("prob_up"))


@add("choose_side", _sql(_SIDE, f"""SELECT {LINE_ID}, side, side_blocked, {rnd('edge', 6)} AS edge, {rnd('true_prob', 6)} AS true_prob,
  CASE WHEN prob_up / greatest(up_price, 1e-9) - 1 - greatest(0.001, up_price * (1 - up_price) * 0.0624) + edge_up * 0.35
    >= prob_down / greatest(1 - up_price, 1e-9) - 1 - greatest(0.001, up_price * (1 - up_price) * 0.0624) + edge_down * 0.35 THEN 'Up' ELSE 'Down' END AS utility_side FROM c2"""))
def _(s, d):
    p = posterior(s, d)
    x = S.choose_side(S.choose_side(p, mode="utility").withColumn("utility_side", F.col("side")))
    return x.select(*LINE_COLS, "side", "side_blocked", round_to("edge", 6).alias("edge"), round_to("true_prob", 6).alias("true_prob"), "utility_side")


@add("copy_adjust", _sql(_COPY, f"SELECT {LINE_ID}, side, score, copy_adj, style_adj, arm_active, {rnd('edge', 6)} AS edge FROM k3"))
def _(s, d):
    return copied(s, d).select(*LINE_COLS, "side", "score", "copy_adj", "style_adj", "arm_active", round_to("edge", 6).alias("edge"))


@add("entry_and_size", _sql(_SIZE, f"SELECT {LINE_ID}, {rnd('entry', 6)} AS entry, use_limit, size_reason, {rnd('size', 4)} AS size, force_taker FROM e8"))
def _(s, d):
    return sized(s, d).select(*LINE_COLS, round_to("entry", 6).alias("entry"), "use_limit", "size_reason", round_to("size", 4).alias("size"), "force_taker")


@add("gate_funnel", _sql(_SIZE, """SELECT duration::BIGINT AS duration, reason, count(*) AS n FROM (SELECT duration, CASE WHEN quote_age_ms > 1200 THEN 'quote_stale' WHEN pct_remaining < 0.15 THEN 'too_late'
  WHEN direction IS NULL THEN 'no_direction' WHEN open_src <> 'PM' THEN 'open_source' WHEN oracle_age_s > 90 THEN 'oracle_stale' WHEN jump_dir <> direction THEN 'jump_against' WHEN ob_sig < -0.40 THEN 'book_against'
  WHEN side_blocked THEN 'edge_hard_block' WHEN NOT cl_agree THEN 'oracle_disagree' WHEN true_prob < CASE WHEN duration <= 5 THEN 0.58 ELSE 0.60 END THEN 'prob_low' WHEN edge < 0.015 THEN 'edge_low'
  ELSE size_reason END AS reason FROM e8) GROUP BY 1, 2"""))
def _(s, d):
    return S.score_snapshot(snapshot(s, d)).groupBy(F.col("duration").cast("bigint").alias("duration"), "reason").agg(F.count("*").alias("n"))


_Q_BIN = "(ln(\"current\" / open_price) - 0.5 * vol * vol * greatest(mins_left / 525600, 1e-9)) / (vol * sqrt(greatest(mins_left / 525600, 1e-9)))"
_QUALITY = _COPY + f""",
q0 AS (SELECT *, CASE side WHEN 'Up' THEN 1e0 ELSE -1e0 END AS g, {_Q_BIN} AS d2v,
    CASE WHEN ws_fresh THEN 0.30 WHEN rest_fresh THEN 0.20 ELSE 0 END + CASE WHEN leader_fresh THEN 0.20 ELSE 0 END + CASE WHEN oracle_age_s <= 30 THEN 0.20 ELSE 0 END
    + CASE WHEN quote_age_ms <= 900 THEN 0.15 ELSE 0 END + CASE WHEN volume_ready THEN 0.15 ELSE 0 END AS quality FROM k3),
q1 AS (SELECT *, 0.15 * greatest(0, least(1, (dw_ob * g + 0.2) / 0.6)) + 0.15 * greatest(0, least(1, ((taker_ratio - 0.5) * g + 0.1) / 0.25)) + 0.15 * greatest(0, least(1, (tf_votes - 1) / 3.0))
    + 0.10 * greatest(0, least(1, (perp_basis * g + 0.0003) / 0.001)) + 0.10 * greatest(0, least(1, (vwap_dev * g + 0.001) / 0.003)) + 0.15 * CASE WHEN cl_agree THEN 1 ELSE 0 END
    + 0.10 * CASE WHEN leader_fresh THEN greatest(0, least(1, (copy_net + 0.2) / 0.8)) ELSE 0.5 END + 0.10 * CASE side WHEN 'Up' THEN {cdf_sql('d2v')} ELSE {cdf_sql('(-d2v)')} END AS conviction FROM q0)"""


@add("analysis_quality", _sql(_QUALITY, f"""SELECT {LINE_ID}, {rnd('quality', 6)} AS quality, {rnd('conviction', 6)} AS conviction,
  {rnd('greatest(0.05, least(0.95, 0.5 + (prob_up - 0.5) * (0.80 + 0.25 * greatest(0, least(1, quality)))))', 6)} AS prob_up FROM q1"""))
def _(s, d):
    x = S.analysis_quality(copied(s, d))
    return x.select(*LINE_COLS, *[round_to(c, 6).alias(c) for c in ("quality", "conviction", "prob_up")])


def _mix(name: str) -> str:
    a, b = S.BLEND[name]
    term = lambda w: f"bt * {w[0]} + tr * {w[1]} + em * {w[2]} + bu * {w[3]}"
    return f"greatest(0.05, least(0.95, CASE WHEN lng THEN {term(a)} ELSE {term(b)} END))"


_PRED = f"""p0 AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'Up' ELSE 'Down' END AS side, l_partkey % 18 AS score, duration >= 15 AS lng, ("current" - open_price) / open_price AS mv FROM snap),
p1 AS (SELECT *, 0.5 + CASE WHEN (mv >= 0 AND side = 'Up') OR (mv < 0 AND side = 'Down') THEN 0.08 ELSE -0.08 END * least(1.0, abs(mv) / 0.0025) AS tr,
    greatest(0.35, least(0.80, CASE WHEN lng THEN 0.65 ELSE 0.55 END + CASE WHEN mins_left <= 2.5 THEN 0.10 WHEN mins_left >= CASE WHEN lng THEN 10 ELSE 3 END THEN -0.05 ELSE 0 END)) AS tw,
    CASE WHEN side_n >= 24 THEN 0.5 + (side_lb - 0.5) * 0.9 + CASE WHEN side_exp > 0.2 THEN 0.015 WHEN side_exp < -0.2 THEN -0.015 ELSE 0 END ELSE 0.5 END AS em,
    CASE WHEN bucket_n >= 12 THEN 0.5 + (bucket_lb - 0.5) * 0.7 + CASE WHEN bucket_exp > 0.2 THEN 0.01 WHEN bucket_exp < -0.2 THEN -0.01 ELSE 0 END ELSE 0.5 END AS bu FROM p0),
p2 AS (SELECT *, base_prob * tw + 0.5 * (1 - tw) AS bt FROM p1),
p3 AS (SELECT *, {_mix('balanced')} AS pb, {_mix('momentum')} AS pm, {_mix('empirical')} AS pe FROM p2),
p4 AS (SELECT *, (pb * 0.5 + pm * 0.3 + pe * 0.2) * 0.7 + CASE variant WHEN 'momentum' THEN pm WHEN 'empirical' THEN pe ELSE pb END * 0.3 AS p FROM p3),
p5 AS (SELECT * EXCLUDE (p), greatest(0.05, least(0.95, CASE WHEN variant_n < 24 THEN p ELSE 0.5 + (p - 0.5) * (1 - greatest(0, least(0.45, (cal_err - 0.20) * 1.10))) END)) AS p FROM p4),
p6 AS (SELECT *, greatest(0.05, least(0.95, 0.5 + (p - 0.5) * CASE WHEN quote_age_ms * 2 > 2200 THEN 0.80 WHEN quote_age_ms * 2 > 1400 THEN 0.90 WHEN quote_age_ms * 2 <= 700 THEN 1.03 ELSE 1 END
    * CASE WHEN analysis_quality < 0.45 THEN 0.92 ELSE 1 END)) AS prob FROM p5),
p7 AS (SELECT *, prob - base_prob AS adj FROM p6)"""


@add("predict_blend", _sql(_PRED, f"""SELECT {LINE_ID}, {rnd('prob', 6)} AS prob, {rnd('adj * 0.65', 6)} AS edge_adj, greatest(-2, least(2, CASE WHEN adj >= 0.03 THEN 1 WHEN adj <= -0.03 THEN -1 ELSE 0 END
  + CASE WHEN side_n >= 40 AND side_lb >= 0.56 AND side_exp > 0 THEN 1 ELSE 0 END - CASE WHEN side_n >= 40 AND side_lb <= 0.46 AND side_exp < 0 THEN 1 ELSE 0 END + CASE WHEN score >= 14 AND adj > 0 THEN 1 ELSE 0 END
  + CASE WHEN quote_age_ms * 2 > 2200 THEN -1 WHEN quote_age_ms * 2 <= 700 AND analysis_quality >= 0.60 AND adj > 0 THEN 1 ELSE 0 END)) AS score_adj FROM p7"""))
def _(s, d):
    x = snapshot(s, d).withColumns({"side": F.when(F.col("l_orderkey") % 2 == 0, "Up").otherwise("Down"), "score": F.col("l_partkey") % 18,
                                    "quote_age_ms": F.col("quote_age_ms") * 2})
    return S.predict_blend(x).select(*LINE_COLS, round_to("prob", 6).alias("prob"), round_to("edge_adj", 6).alias("edge_adj"), "score_adj")


_FLAGS = _SIZE + """,
f0 AS (SELECT *, ("current" - open_price) / open_price AS mv, CASE WHEN "current" >= open_price THEN 'Up' ELSE 'Down' END AS beat, CASE WHEN up_price <= 1 - up_price THEN 'Up' ELSE 'Down' END AS cheap FROM e8),
f1 AS (SELECT *, coalesce(duration >= 15 AND least(up_price, 1 - up_price) <= 0.35 AND mins_left >= 7 AND abs(mv) >= 0.001 AND cheap <> direction, false) AS tail,
    coalesce(mins_left <= CASE WHEN duration <= 5 THEN 1 ELSE 3 END AND abs(mv) >= 0.001 AND side <> beat, false) AS late,
    coalesce(duration >= 15 AND mins_left <= 9 AND abs(mv) >= 0.001 AND side <> beat AND NOT (score >= 14 AND true_prob >= 0.70), false) AS contra,
    coalesce(pct_remaining <= 0.35 AND duration >= 15 AND abs(mv) >= 0.0012 AND side = beat AND CASE side WHEN 'Up' THEN taker_ratio >= 0.52 ELSE taker_ratio <= 0.48 END, false) AS locked,
    greatest(0.6, least(1.4, abs(mv) / 0.001)) AS sc FROM f0),
f2 AS (SELECT *, CASE WHEN late THEN beat WHEN tail THEN cheap ELSE side END AS flag_side,
    CASE WHEN contra THEN -greatest(1, round_even(round(2 * sc, 9), 0)::INT) ELSE 0 END + CASE WHEN late THEN -1 ELSE 0 END AS flag_score,
    CASE WHEN contra THEN -greatest(0.004, 0.010 * sc) ELSE 0 END + CASE WHEN late THEN -0.004 ELSE 0 END AS flag_edge, CASE WHEN contra THEN 0.6 ELSE 1.0 END AS flag_size_mult FROM f1)"""


@add("situation_flags", _sql(_FLAGS, f"""SELECT {LINE_ID}, tail AS contrarian_tail, late AS late_lock, contra AS event_contra, locked AS late_locked, flag_side, flag_score, {rnd('flag_edge', 6)} AS flag_edge,
  {rnd('''0.25 * greatest(0, least(1, (tf_votes - 1) / 3.0)) + 0.20 * greatest(0, least(1, dw_ob * CASE side WHEN 'Up' THEN 1 ELSE -1 END / 0.4))
    + 0.15 * greatest(0, least(1, (taker_ratio - 0.5) * CASE side WHEN 'Up' THEN 1 ELSE -1 END / 0.15)) + 0.10 * greatest(0, least(1, vol_ratio - 1))
    + 0.10 * greatest(0, least(1, perp_basis * CASE side WHEN 'Up' THEN 1 ELSE -1 END / 0.0008)) + 0.10 * greatest(0, least(1, vwap_dev * CASE side WHEN 'Up' THEN 1 ELSE -1 END / 0.002))
    + 0.10 * CASE WHEN cl_agree THEN 1 ELSE 0 END''', 6)} AS booster FROM f2"""))
def _(s, d):
    x = S.situation_flags(sized(s, d)).withColumn("booster", S.booster_conviction())
    return x.select(*LINE_COLS, "contrarian_tail", "late_lock", "event_contra", "late_locked", "flag_side", "flag_score",
                    round_to("flag_edge", 6).alias("flag_edge"), round_to("booster", 6).alias("booster"))


def _steps() -> str:
    """The stake steps in order, one CTE each."""
    r2 = lambda x: rnd(x, 2)
    cheap = "(duration >= 15 AND entry <= 0.15 AND 1 / entry >= 6.0)"
    floor_ = f"CASE WHEN {cheap} AND score >= 10 AND ev >= 0.05 AND x < 1.5 THEN least(hard_cap, greatest(x, 1.5)) ELSE x END"
    cap = f"CASE WHEN {cheap} AND x > greatest(0.5, least(3.0, bankroll * 0.05)) THEN {r2('greatest(0.5, least(3.0, bankroll * 0.05))')} ELSE x END"
    push = "CASE push_tier WHEN 'push' THEN 1.15 WHEN 'base' THEN 1.0 ELSE 0.7 END"
    steps = [
        floor_, cap,
        f"""CASE WHEN duration >= 15 AND entry BETWEEN 0.40 AND 0.55 AND score >= 10 AND ev >= 0.02 THEN {r2('least(hard_cap, x * 1.10)')}
            WHEN duration >= 15 AND entry <= 0.25 AND NOT (score >= 13 AND ev >= 0.05) THEN {r2('greatest(1.0, least(hard_cap, x * 0.60))')} ELSE x END""",
        f"CASE WHEN duration >= 15 AND flag_size_mult <> 1 THEN {r2('greatest(1.0, least(hard_cap, x * flag_size_mult))')} ELSE x END",
        f"CASE WHEN duration >= 15 AND entry <= 0.30 AND NOT (score >= 14 AND true_prob >= 0.70) THEN greatest(1.0, {r2('x * 0.75')}) ELSE x END",
        f"CASE WHEN duration >= 15 AND same_side_legs > 0 THEN greatest(1.0, {r2('x * greatest(0.35, power(0.70, same_side_legs))')}) ELSE x END",
        f"CASE WHEN duration >= 15 AND round_legs > 0 THEN greatest(1.0, {r2('x * greatest(0.45, power(0.85, round_legs))')}) ELSE x END",
        f"CASE WHEN {push} <> 1.0 THEN greatest(1.0, {r2(f'least(hard_cap, x * {push})')}) ELSE x END",
        floor_, cap, r2("least(x, 4.0)"),
    ]
    out = ["""z0 AS MATERIALIZED (SELECT *, size AS x, CASE WHEN score >= 13 AND true_prob >= 0.64 AND ev >= 0.03 AND cl_agree THEN 'push' WHEN score >= 9 AND ev >= 0.01 THEN 'base' ELSE 'probe' END AS push_tier FROM f2 WHERE size_reason = 'ok')"""]
    for i, e in enumerate(steps):
        out.append(f"z{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (x), {e} AS x FROM z{i})")
    return ",\n".join(out)


@add("size_modifiers", _sql(_FLAGS + ",\n" + _steps(), f"SELECT {LINE_ID}, push_tier, {rnd('x', 2)} AS final_size FROM z11"))
def _(s, d):
    x = S.situation_flags(sized(s, d).where("size_reason = 'ok'"))
    return S.size_modifiers(x, S.SizeConfig(max_size=4.0)).select(*LINE_COLS, "push_tier", round_to("final_size", 2).alias("final_size"))


@add("round_best", _sql(_SIZE, f"""SELECT l_partkey AS round_id, CASE WHEN duration <= 5 THEN '5m' ELSE '15m' END AS duration_class, arg_max(l_orderkey, (growth, -l_orderkey, -l_linenumber, -l_suppkey)) AS l_orderkey,
  {rnd('max(growth)', 6)} AS growth FROM (SELECT *, round(true_prob / greatest(entry, 1e-6) - 1 - 0.0156 + edge * 0.35 + (1 / entry - 1) * 0.06 + score * 0.003 + CASE WHEN cl_agree THEN 0.02 ELSE -0.03 END
  + CASE WHEN quote_age_ms > 900 THEN -0.03 ELSE 0 END, 9) AS growth FROM e8 WHERE entry IS NOT NULL) GROUP BY 1, 2"""))
def _(s, d):
    from marketlens.functions.prob import growth_score
    from marketlens.operators.positions import round_best
    x = sized(s, d).where("entry IS NOT NULL").withColumn("growth", F.round(growth_score(
        "entry", "score", "edge", "true_prob", "cl_agree", "quote_age_ms", F.lit(0.0)), 9)).withColumnRenamed("l_partkey", "round_id")
    b = round_best(x, ["round_id"], tie=["l_orderkey", "l_linenumber", "l_suppkey"])
    return b.select("round_id", "duration_class", "l_orderkey", round_to("growth", 6).alias("growth"))


# ---------------------------------------------------------------- decisions over market data
# A decision of a line item falls into January 2024 and reads one feed; what its scores need comes from five sources as of then.
_FEEDS = ("click", "error", "purchase", "signup", "view")
_DECISION_S = "1704153600 + (l_orderkey * 1009 + l_partkey * 131 + l_linenumber * 17) % 2505600"
_MID = "100e0 + value / 250e0"
_MARKET = {
    "current": "quote", "open_price": "bar_open", "quote_age_ms": "quote_age_s", "oracle_price": "oracle", "oracle_age_s": "oracle_age_s / 60e0",
    "perp_basis": "(perp - quote) / quote", "ema5": "quote", "ema60": "bar_close", "taker_ratio": "bar_taker / bar_volume", "vol_ratio": "bar_volume / 8e0",
    "vwap_dev": "(quote - bar_close) / bar_close", "dw_ob": "greatest(-0.6e0, least(0.6e0, (quote - bar_close) / 0.5e0))",
}


def decisions(s, d):
    """Line items with the market as of their decision time: one union and one order for all five sources."""
    feed = F.element_at(F.array(*[F.lit(x) for x in _FEEDS]), (F.col("l_suppkey") % len(_FEEDS) + 1).cast("int"))
    left = V.table(tune(s), d, "lineitem").withColumns({"feed": feed, "at": F.timestamp_seconds(F.expr(_DECISION_S))})
    q = V.table(s, d, "events").select(F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_MID).alias("mid"), "user_id")
    bars = V.bars(s, d).withColumnRenamed("asset", "feed").withColumns({"closed": F.col("ts") + F.expr("INTERVAL 1 HOUR"), "o": (F.col("o") - 100) / 250 + 100, "c": (F.col("c") - 100) / 250 + 100})
    x = asof_many(left, [
        Source(q, "ts", {"quote": "mid", "quote_ts": "ts"}), Source(bars, "ts", {"bar_open": "o"}),
        Source(bars, "closed", {"bar_close": "c", "bar_volume": "v", "bar_taker": "taker_v"}),
        Source(q.where("user_id % 5 = 0"), "ts", {"oracle": "mid", "oracle_ts": "ts"}, tolerance_s=43_200), Source(q.where("user_id % 3 = 0"), "ts", {"perp": "mid"})], ["feed"], left_ts="at")
    return x.withColumns({"quote_age_s": (F.unix_micros("at") - F.unix_micros("quote_ts")) / 1e6, "oracle_age_s": (F.unix_micros("at") - F.unix_micros("oracle_ts")) / 1e6}) \
        .where("quote IS NOT NULL AND bar_open IS NOT NULL AND bar_close IS NOT NULL AND perp IS NOT NULL")


_DECISIONS = V.with_views("bars", f"""q AS (SELECT event_type AS feed, epoch_us(ts) AS t, {_MID} AS mid, user_id FROM events),
oracles AS (SELECT * FROM q WHERE user_id % 5 = 0), perps AS (SELECT * FROM q WHERE user_id % 3 = 0),
opened AS (SELECT asset AS feed, t, (o - 100) / 250 + 100 AS o FROM bars), closed AS (SELECT asset AS feed, t + 3600000000 AS t, (c - 100) / 250 + 100 AS c, v, taker_v FROM bars),
dec AS (SELECT *, list_extract({list(_FEEDS)}, l_suppkey % {len(_FEEDS)} + 1) AS feed, ({_DECISION_S}) * 1000000 AS due FROM lineitem),
market AS (SELECT dec.*, q.mid AS quote, (due - q.t) / 1e6 AS quote_age_s, opened.o AS bar_open, closed.c AS bar_close, closed.v AS bar_volume, closed.taker_v AS bar_taker,
    CASE WHEN due - oracles.t <= 43200000000 THEN oracles.mid END AS oracle, CASE WHEN due - oracles.t <= 43200000000 THEN (due - oracles.t) / 1e6 END AS oracle_age_s, perps.mid AS perp
  FROM dec ASOF JOIN q ON dec.feed = q.feed AND dec.due >= q.t ASOF JOIN opened ON dec.feed = opened.feed AND dec.due >= opened.t ASOF JOIN closed ON dec.feed = closed.feed AND dec.due >= closed.t
  ASOF LEFT JOIN oracles ON dec.feed = oracles.feed AND dec.due >= oracles.t ASOF JOIN perps ON dec.feed = perps.feed AND dec.due >= perps.t),
snap AS (SELECT """ + LINE_ID + ", " + ", ".join(f'{t} AS "{n}"' for n, t in (SNAPSHOT | _MARKET).items()) + " FROM market)").rstrip()


@add("decision_reasons", _DECISIONS + ",\n" + _SIZE + f""" SELECT {LINE_ID}, {rnd('"current"', 6)} AS "current", {rnd('oracle_price', 6)} AS oracle_price, {rnd('oracle_age_s', 6)} AS oracle_age_s,
  {rnd('taker_ratio', 6)} AS taker_ratio, {rnd('perp_basis', 6)} AS perp_basis, CASE WHEN quote_age_ms > 1200 THEN 'quote_stale'
  WHEN pct_remaining < 0.15 THEN 'too_late' WHEN direction IS NULL THEN 'no_direction' WHEN open_src <> 'PM' THEN 'open_source' WHEN oracle_age_s > 90 THEN 'oracle_stale' WHEN jump_dir <> direction THEN 'jump_against'
  WHEN ob_sig < -0.40 THEN 'book_against' WHEN side_blocked THEN 'edge_hard_block' WHEN NOT cl_agree THEN 'oracle_disagree' WHEN true_prob < CASE WHEN duration <= 5 THEN 0.58 ELSE 0.60 END THEN 'prob_low'
  WHEN edge < 0.015 THEN 'edge_low' ELSE size_reason END AS reason FROM e8""")
def _(s, d):
    x = decisions(s, d)
    snap = x.select(*LINE_COLS, *[F.expr(t).alias(n) for n, t in (SNAPSHOT | _MARKET).items()])
    return S.score_snapshot(snap).select(*LINE_COLS, *[round_to(c, 6).alias(c) for c in ("current", "oracle_price", "oracle_age_s", "taker_ratio", "perp_basis")], "reason")
