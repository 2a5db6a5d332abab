"""Signal scoring over a snapshot table: one row per (market, decision time).

Every step is ``DataFrame -> DataFrame`` and adds named columns, so each point of a score can be
audited; nothing shuffles. Statistics and features arrive as columns, joined beforehand. The same
steps serve batch tables and streams.

Snapshot columns: asset, duration, up_price, open_price, open_src, current, oracle_price, oracle_age_s,
quote_age_ms, mins_left, pct_remaining, mom_5s, mom_30s, mom_180s, mom_kal, dw_ob, taker_ratio, vol_ratio,
perp_basis, funding_rate, vwap_dev, vol_mult, vol, others_up, others_down, lead_p, autocorr, vr_ratio,
jump_dir, prev_dir, prev_move, ema5, ema60, kal_vel, bias_up, bias_down, shrink.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import c, clamp, first_reason, round_to, step
from ..functions.prob import (FEE_FALLBACK, adaptive_thresholds, binary_d2_prob, entry_tier, ev_net, kelly_size,
                              logistic, model_cap, payout_mult, platt)

LEADER = "BTC"
SECONDS = (252 * 24 * 3600) ** 0.5
SIGMA_15M = (15 / (252 * 390)) ** 0.5
TF_HIGH, TF_LOW = 0.53, 0.47


def _b(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _if(cond: Column, a, b) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)


def settled(x: Column) -> Column:
    """``x``, evaluated where it stands.

    A filter on a late column would otherwise be pushed down through every step, and each step would copy the earlier
    expressions into it several times over. Spark pushes no filter below a projection that depends on the partition.
    """
    return F.when(F.spark_partition_id() >= 0, x)


def direction(s: DataFrame, *, move_min: float = 0.0003, oracle_min: float = 0.0002, conflict_max: float = 0.0010) -> DataFrame:
    """Side the price points to: tick move, else oracle move, else momentum votes.

    A small tick move against a clear oracle move leaves the direction null.
    """
    cur, op, o = F.col("current"), F.col("open_price"), F.coalesce("oracle_price", F.lit(0.0))
    moms = [F.col(x) for x in ("mom_5s", "mom_30s", "mom_180s", "mom_kal")]
    up = sum((_b(m > TF_HIGH) for m in moms[1:]), _b(moms[0] > TF_HIGH))
    dn = sum((_b(m < TF_LOW) for m in moms[1:]), _b(moms[0] < TF_LOW))
    ref = op > 0
    s = s.withColumns({"move_pct": F.when(ref, F.abs(cur - op) / op).otherwise(0.0), "tf_up_votes": up, "tf_dn_votes": dn,
                       "oracle_dir": F.when(ref & (o > 0) & (F.abs(o - op) / op >= oracle_min), _if(o > op, "Up", "Down"))})
    tick_dir = _if(cur > op, "Up", "Down")
    conflict = F.col("oracle_dir").isNotNull() & (F.col("oracle_dir") != tick_dir) & (F.col("move_pct") < conflict_max)
    d = (F.when(F.col("move_pct") >= move_min, F.when(~conflict, tick_dir))
         .when(F.col("oracle_dir").isNotNull(), F.col("oracle_dir"))
         .when(F.col("tf_up_votes") > F.col("tf_dn_votes"), "Up").when(F.col("tf_dn_votes") > F.col("tf_up_votes"), "Down"))
    s = s.withColumn("direction", d).withColumn("is_up", F.coalesce(F.col("direction") == "Up", F.lit(False)))
    return s.withColumns({
        "tf_votes": _if(F.col("is_up"), F.col("tf_up_votes"), F.col("tf_dn_votes")),
        "cl_agree": _if(ref & (o > 0), F.col("is_up") == (o > op), True),
        "ob_sig": _if(F.col("is_up"), F.col("dw_ob"), -F.col("dw_ob")),
        "cross_count": _if(F.col("is_up"), F.col("others_up"), F.col("others_down"))})


# Points of the score sheet, in the order they are added.
SHEET = ("timing", "move", "votes", "oracle", "source", "jump", "book", "taker", "volume", "basis", "funding", "vwap",
         "displacement", "cross", "lead", "continuation", "regime")


def score_sheet(s: DataFrame) -> DataFrame:
    """One ``pts_*`` column per component, and their sum ``score``."""
    up = F.coalesce(F.col("is_up"), F.lit(False))
    sign = _if(up, 1.0, -1.0)
    pct, lead = F.col("pct_remaining"), _if(up, F.col("lead_p"), 1.0 - F.col("lead_p"))
    tk, basis, fund = (F.col("taker_ratio") - 0.5) * sign, F.col("perp_basis") * sign, F.col("funding_rate")
    tk = F.round(tk, 9)
    vw = F.col("vwap_dev") * sign
    disp = F.when(F.col("open_price") > 0, (F.col("current") - F.col("open_price")) / F.col("open_price") * sign)
    z = disp / (F.col("vol") * SIGMA_15M)
    same_prev = F.col("prev_dir") == F.col("direction")
    trend = (F.col("vr_ratio") > 1.05) & (F.col("autocorr") > 0.05)
    revert = (F.col("vr_ratio") < 0.95) & (F.col("autocorr") < -0.05)
    age = F.col("oracle_age_s")
    pts = {
        "timing": step(pct, ((0.85, 2), (0.70, 1)), 0),
        "move": step("move_pct", ((0.0020, 3), (0.0012, 2), (0.0005, 1)), 0),
        "votes": step("tf_votes", ((4, 5), (3, 4), (2, 2)), 0),
        "oracle": _if(F.col("cl_agree"), 1, -3),
        "source": (F.when(F.col("open_src") == "PM", 1).when(F.col("open_src") == "CL-exact", 0).otherwise(-1)
                   + F.when(age.isNull(), -1).when(age > 45, -2).otherwise(0)),
        "jump": _if(F.col("jump_dir") == F.col("direction"), 2, 0),
        "book": step("ob_sig", ((0.25, 3), (0.10, 2), (-0.10, 1)), -1, op="gt"),
        "taker": (F.when(tk > 0.12, 3).when(tk > 0.05, 2).when(F.abs(tk) < 0.05, 1).otherwise(-1)),
        "volume": step("vol_ratio", ((2.0, 2), (1.3, 1)), 0, op="gt"),
        "basis": F.when(basis > 0.0005, 2).when(basis > 0.0002, 1).when(basis < -0.0002, -1).otherwise(0),
        "funding": (F.when(~up & (fund > 0.0005), 1).when(up & (fund < -0.0002), 1).when(up & (fund > 0.0010), -1)
                    .when(~up & (fund < -0.0005), -1).otherwise(0)),
        "vwap": F.when(vw > 0.0015, 2).when(vw > 0.0008, 1).when(vw < -0.0015, -2).when(vw < -0.0008, -1).otherwise(0),
        "displacement": F.when(z > 1.0, 2).when(z > 0.5, 1).when(z < -1.0, -2).when(z < -0.5, -1).otherwise(0),
        "cross": F.when(F.col("cross_count") == 3, 2).when(F.col("cross_count") >= 2, 1).otherwise(0),
        "lead": F.when(F.col("asset") == LEADER, 0).when(lead > 0.60, 2).when(lead > 0.55, 1).when(lead < 0.40, -1).otherwise(0),
        "continuation": (F.when(F.col("prev_dir").isNull(), 0)
                         .when(same_prev, step(pct, ((0.85, 5), (0.80, 4), (0.70, 2)), 1, op="gt")).otherwise(-2)),
        "regime": F.when(trend, 1).when(revert, -1).otherwise(0),
    }
    s = s.withColumns({f"pts_{k}": pts[k] for k in SHEET})
    total = F.col(f"pts_{SHEET[0]}")
    for k in SHEET[1:]:
        total = total + F.col(f"pts_{k}")
    return s.withColumns({"score": settled(total), "regime_mult": F.when(trend, 1.15).when(revert, 0.85).otherwise(1.0)})


@dataclass(frozen=True)
class LlrWeights:
    """Weights of the log-likelihood terms; the last four are off unless set."""

    price: float = 1.5
    ema: float = 300.0
    velocity: float = 0.4
    book: float = 2.5
    taker: float = 5.0
    basis: float = 1000.0
    basis_cap: float = 1.5
    agree: float = 0.4
    disagree: float = 1.0
    lead: float = 3.0
    clamp: float = 6.0
    bridge_max: float = 0.0
    trend20: float = 0.0
    trend12: float = 0.0
    crowd: float = 0.0


def llr_posterior(s: DataFrame, w: LlrWeights = LlrWeights(), *, platt_ab: tuple[float, float] | None = None) -> DataFrame:
    """Adds the additive log-likelihood terms and ``prob_up`` / ``prob_down``."""
    cur, op, sig = F.col("current"), F.col("open_price"), F.col("vol") * SIGMA_15M
    z = F.when((op > 0) & (sig > 0), (cur - op) / op / sig).otherwise(0.0)
    b = F.col("perp_basis")
    terms = {
        "price": z * w.price,
        "ema": F.when(F.col("ema60") > 0, (F.col("ema5") / F.col("ema60") - 1.0) * w.ema).otherwise(0.0),
        "velocity": F.coalesce(F.col("kal_vel") / F.greatest(F.col("vol") / SECONDS, F.lit(1e-8)) * w.velocity, F.lit(0.0)),
        "book": F.col("dw_ob") * w.book,
        "taker": (F.col("taker_ratio") - 0.5) * w.taker,
        "basis": F.when(F.abs(b) > 1e-7, F.signum(b) * F.least(F.abs(b) * w.basis, F.lit(w.basis_cap))).otherwise(0.0),
        "oracle": _if(F.col("cl_agree"), w.agree, -w.disagree),
        "lead": F.when(F.col("asset") == LEADER, 0.0).otherwise((F.col("lead_p") - 0.5) * w.lead),
    }
    if w.bridge_max:
        left = F.greatest(F.col("mins_left") * 60.0, F.lit(30.0))
        amp = F.least(F.lit(w.bridge_max), F.sqrt(F.col("duration") * 60.0 / left)) - 1.0
        terms["bridge"] = z * w.price * F.greatest(amp, F.lit(0.0))
    for name, weight in (("trend20", w.trend20), ("trend12", w.trend12), ("crowd", w.crowd)):
        if weight:
            terms[name] = F.coalesce(F.col({"crowd": "crowd_velocity"}.get(name, name)), F.lit(0.0)) * weight
    s = s.withColumns({f"llr_{k}": v for k, v in terms.items()})
    total = F.lit(0.0)
    for k in terms:
        total = total + F.col(f"llr_{k}")
    s = s.withColumn("llr", total * F.col("regime_mult"))
    p = logistic(F.col("llr"), w.clamp)
    up0 = clamp(p + F.col("bias_up"), 0.05, 0.95)
    if platt_ab is not None:
        up0 = platt(up0, *platt_ab)
    dn0 = clamp(1.0 - p + F.col("bias_down"), 0.05, 0.95)
    prior = F.least(F.lit(0.68), 0.58 + F.col("prev_move") * 10)
    early = (F.col("prev_dir") == F.col("direction")) & (F.col("pct_remaining") > 0.80)
    cont = (F.when(F.coalesce(early, F.lit(False)) & F.col("is_up"), F.greatest(up0, prior))
            .when(F.coalesce(early, F.lit(False)), 1.0 - F.greatest(dn0, prior)).otherwise(up0))
    s = s.withColumn("prob_up", clamp(0.5 + (cont - 0.5) * F.col("shrink"), 0.05, 0.95))
    return s.withColumn("prob_down", 1.0 - F.col("prob_up")).withColumns({
        "edge_up": F.col("prob_up") - F.col("up_price"), "edge_down": F.col("prob_down") - (1.0 - F.col("up_price"))})


def _by_side(side: Column, up: str | Column, down: str | Column) -> Column:
    return F.when(side == "Up", c(up)).when(side == "Down", c(down))


def choose_side(s: DataFrame, *, mode: str = "prob", forced_move: float = 0.0005, hard_block: float = -0.15, floor: float = 0.01,
                utility_edge: float = 0.35) -> DataFrame:
    """Adds side, edge, true_prob and ``side_blocked``.

    ``direction`` keeps the price side; ``prob`` takes the likelier side; ``utility`` the side with more
    expected value. The hard block always looks at the price side.
    """
    base = F.when(F.col("move_pct") >= forced_move, _if(F.col("current") > F.col("open_price"), "Up", "Down")).otherwise(F.col("direction"))
    e = _by_side(base, "edge_up", "edge_down")
    forced = F.col("move_pct") >= forced_move
    s = s.withColumns({"_base": base, "_e": e, "side_blocked": F.coalesce(e < hard_block, F.lit(True))})
    if mode == "direction":
        s = s.withColumns({"side": F.col("_base"),
                           "edge": _if(forced & (F.col("_e") >= 0), F.col("_e"), F.greatest(F.lit(floor), F.col("_e")))})
    else:
        if mode == "utility":
            up = F.col("up_price")
            fee = F.greatest(F.lit(0.001), up * (1 - up) * FEE_FALLBACK)
            u = F.col("prob_up") * payout_mult(up) - 1 - fee + F.col("edge_up") * utility_edge
            d = F.col("prob_down") * payout_mult(1 - up) - 1 - fee + F.col("edge_down") * utility_edge
            pick = _if(u >= d, "Up", "Down")
        else:
            pick = _if(F.col("prob_up") >= F.col("prob_down"), "Up", "Down")
        s = s.withColumn("side", settled(pick)).withColumn("edge", _by_side(F.col("side"), "edge_up", "edge_down"))
    return s.withColumn("true_prob", _by_side(F.col("side"), "prob_up", "prob_down")).drop("_base", "_e")


def copy_adjust(s: DataFrame, *, bonus_max: int = 2, win_mode: bool = True, arm_score: int = 2, arm_edge: float = 0.05,
                min_conf: float = 0.58) -> DataFrame:
    """Leader flow, buying style and pre-bid arm applied to score, edge and side.

    Flow columns (null without flow): flow_up, flow_down, avg_entry_c, low_c_share, high_c_share, multibet_ratio;
    arm columns (null when not armed): arm_side, arm_conf.
    """
    has = F.col("flow_up").isNotNull()
    net = _if(F.col("side") == "Up", F.col("flow_up") - F.col("flow_down"), F.col("flow_down") - F.col("flow_up"))
    s = s.withColumn("copy_net", F.when(has, F.round(net, 9)).otherwise(0.0))
    s = s.withColumn("copy_adj", F.bround(F.round(clamp(F.col("copy_net") * bonus_max, -bonus_max, bonus_max), 9), 0).cast("int"))
    paid = _by_side(F.col("side"), F.col("up_price"), 1.0 - F.col("up_price"))
    follow = has & (F.col("avg_entry_c") > 0) & (F.col("high_c_share") >= 0.60) & (F.col("multibet_ratio") >= 0.30)
    fade = has & (F.col("avg_entry_c") > 0) & (F.col("low_c_share") >= 0.60) & (paid > 0.55)
    style = F.when(F.coalesce(follow, F.lit(False)), 1).when(F.coalesce(fade, F.lit(False)), -1).otherwise(0)
    armed = F.coalesce(F.col("arm_conf") >= min_conf, F.lit(False))
    s = s.withColumns({"style_adj": style, "arm_active": armed})
    s = s.withColumns({
        "score": F.col("score") + F.col("copy_adj") + F.col("style_adj") + F.when(F.col("arm_active"), arm_score).otherwise(0),
        "edge": (F.col("edge") + F.col("copy_net") * 0.01 + F.col("style_adj") * 0.005
                 + F.when(F.col("arm_active"), F.greatest(F.lit(0.0), F.col("arm_conf") - 0.5) * arm_edge).otherwise(0.0)),
        "side": F.when(F.col("arm_active") & F.col("arm_side").isin("Up", "Down"), F.col("arm_side")).otherwise(F.col("side"))})
    p, e = _by_side(F.col("side"), "prob_up", "prob_down"), _by_side(F.col("side"), "edge_up", "edge_down")
    keep = (lambda a, b: F.greatest(a, b)) if win_mode else (lambda a, b: b)
    return s.withColumns({"true_prob": keep(F.col("true_prob"), p), "edge": keep(F.col("edge"), e),
                          "entry_ref": _by_side(F.col("side"), F.col("up_price"), 1.0 - F.col("up_price"))})


@dataclass(frozen=True)
class EntryConfig:
    """Entry band, gates and stake limits."""

    min_score_5m: int = 8
    min_score_15m: int = 6
    max_entry: float = 0.58
    max_entry_tol: float = 0.015
    min_entry_5m: float = 0.35
    max_entry_5m: float = 0.52
    win_mode: bool = True
    win_max_entry_5m: float = 0.60
    win_max_entry_15m: float = 0.56
    min_ev: float = 0.018
    pullback: bool = True
    pullback_min_pct: float = 0.25
    hc15: bool = False
    hc15_score: int = 10
    hc15_prob: float = 0.62
    hc15_edge: float = 0.10
    hc15_target: float = 0.30
    hc15_min_pct: float = 0.35
    min_bet: float = 1.50
    min_bet_pct: float = 0.01
    max_cid_pct: float = 0.10
    max_bank_pct: float = 0.35
    fast_exec: bool = False
    fast_score: int = 6
    fast_edge: float = 0.02


def entry_and_size(s: DataFrame, cfg: EntryConfig = EntryConfig()) -> DataFrame:
    """Entry band, limit or pullback, value gates, Kelly tier and scales.

    Adds entry, use_limit, payout_mult, ev, size, force_taker and ``size_reason`` (``ok`` or the gate that
    refused). Expects ask (null without a book), bankroll, dd_scale, wr_scale, bucket_scale, and the
    growth columns outcomes, pf, expectancy, avg_slip, consec_losses.
    """
    five, score, p = F.col("duration") <= 5, F.col("score"), F.col("true_prob")
    need = F.when(five, cfg.min_score_5m).otherwise(cfg.min_score_15m)
    need = F.when(F.col("arm_active"), F.greatest(F.lit(0), need - 2)).otherwise(need)
    hi = F.least(F.lit(0.97), cfg.max_entry + cfg.max_entry_tol + step(score, ((12, 0.02), (9, 0.01)), 0.0))
    caps5 = min(cfg.max_entry_5m, cfg.win_max_entry_5m) if cfg.win_mode else cfg.max_entry_5m
    hi = F.when(five, F.least(hi, F.lit(caps5))).otherwise(F.least(hi, F.lit(cfg.win_max_entry_15m)) if cfg.win_mode else hi)
    hi = F.when(score >= 9, F.greatest(hi, F.least(F.lit(0.85), model_cap(p, cfg.min_ev)))).otherwise(hi)
    pay_req, ev_req, hard = adaptive_thresholds("duration", "outcomes", "pf", "expectancy", "avg_slip", "consec_losses")
    s = s.withColumns({"min_entry": F.when(five, cfg.min_entry_5m).otherwise(0.01), "max_entry": F.least(hi, hard),
                       "_need": need, "_pay": pay_req, "_ev": ev_req, "_live": F.coalesce("ask", "entry_ref")})
    hc = F.lit(False)
    if cfg.hc15:
        hc = ((F.col("duration") == 15) & (score >= cfg.hc15_score) & (p >= cfg.hc15_prob) & (F.col("edge") >= cfg.hc15_edge)
              & (F.col("pct_remaining") > cfg.hc15_min_pct) & (F.col("_live") > cfg.hc15_target))
    inside = F.col("_live").between(F.col("min_entry"), F.col("max_entry"))
    pull = F.lit(cfg.pullback) & (F.col("pct_remaining") >= cfg.pullback_min_pct)
    s = s.withColumns({
        "entry": settled(F.when(hc, F.least(F.lit(cfg.hc15_target), F.col("max_entry"))).when(inside, F.col("_live")).when(pull, F.col("max_entry"))),
        "use_limit": hc | (~inside & pull)})
    s = s.withColumns({"payout_mult": payout_mult("entry"), "ev": ev_net(p, "entry")})
    kf, bp = entry_tier("entry", "score")
    bank = F.col("bankroll")
    disagree_fresh = ~F.col("cl_agree") & F.coalesce(F.col("oracle_age_s") <= 45, F.lit(False))
    oracle_scale = F.when(disagree_fresh, 0.60).when(~F.col("cl_agree"), 0.80).otherwise(1.0)
    cap = F.greatest(F.lit(0.50), F.least(F.least(F.lit(100.0), bank * bp), F.greatest(F.lit(0.50), bank * cfg.max_cid_pct), bank * cfg.max_bank_pct))
    raw = kelly_size(p, "entry", kf, bank, F.col("dd_scale"), cfg.max_bank_pct)
    s = s.withColumns({"hard_cap": cap, "_raw": raw * F.col("vol_mult") * F.col("wr_scale") * oracle_scale * F.col("bucket_scale")})
    s = s.withColumns({"_model": round_to(F.least(F.col("hard_cap"), F.col("_raw")), 2),
                       "_floor": F.least(F.col("hard_cap"), F.greatest(F.lit(cfg.min_bet), bank * cfg.min_bet_pct))})
    small = F.col("_model") < F.col("_floor")
    sure = (score >= 12) & (p >= 0.62) & (F.col("edge") >= 0.03)
    size = F.greatest(F.lit(0.50), F.least(F.col("hard_cap"), F.when(small, round_to("_floor", 2)).otherwise(F.col("_model"))))
    reason = first_reason([
        (score < F.col("_need"), "score_below"), (F.col("entry").isNull(), "entry_outside"),
        (F.col("payout_mult") < F.col("_pay"), "payout_below"), (F.col("ev") < F.col("_ev"), "ev_below"), (small & ~sure, "size_too_small")])
    strong = (score >= 12) & (((F.col("tf_votes") >= 3) & (F.col("ob_sig") > 0.10) & (F.col("move_pct") > 0.0015))
                              | ((F.col("prev_dir") == F.col("direction")) & (F.col("pct_remaining") > 0.85)))
    taker = F.coalesce(strong, F.lit(False))
    if cfg.fast_exec:
        taker = taker | ((score >= cfg.fast_score) & (F.col("edge") >= cfg.fast_edge) & (F.col("entry") <= cfg.max_entry))
    s = s.withColumn("size_reason", settled(reason))
    return s.withColumns({
        "size": F.when(F.col("size_reason") == "ok", size),
        "force_taker": (~F.col("use_limit") & taker) | F.col("arm_active")}).drop("_need", "_pay", "_ev", "_live", "_raw", "_model", "_floor")


def score_snapshot(s: DataFrame, *, mode: str = "prob", entry: EntryConfig = EntryConfig()) -> DataFrame:
    """The whole funnel; ``reason`` is the first gate that refused, in evaluation order.

    The gates before scoring read a few columns of the snapshot, so they filter first: a row they refuse is never scored
    (its scored columns are null), and a caller that counts reasons reads only the gates' columns for it."""
    from ..functions.gates import high_win_reason, snapshot_gate_reason
    d = direction(s).withColumn("_pre", settled(snapshot_gate_reason()))
    refused = d.where(F.col("_pre") != "ok").withColumnRenamed("_pre", "reason")
    d = copy_adjust(choose_side(llr_posterior(score_sheet(d.where(F.col("_pre") == "ok").drop("_pre"))), mode=mode))
    d = entry_and_size(d.withColumn("_win", high_win_reason() if mode == "prob" else F.lit("ok")), entry)
    d = d.withColumn("reason", F.when(F.col("side_blocked"), "edge_hard_block").when(F.col("_win") != "ok", F.col("_win")).otherwise(F.col("size_reason"))).drop("_win")
    return d.unionByName(refused, allowMissingColumns=True)


# ---------------------------------------------------------------- quality and conviction
@dataclass(frozen=True)
class QualityWeights:
    """Weights of data freshness and of agreement; ours, to be tuned."""

    ws: float = 0.30
    rest: float = 0.20
    leader: float = 0.20
    oracle: float = 0.20
    quote: float = 0.15
    volume: float = 0.15
    conviction: dict[str, float] = field(default_factory=lambda: {
        "book": 0.15, "taker": 0.15, "votes": 0.15, "basis": 0.10, "vwap": 0.10, "oracle": 0.15, "leader": 0.10, "binary": 0.10})
    scale_min: float = 0.80
    scale_max: float = 1.05


def analysis_quality(s: DataFrame, w: QualityWeights = QualityWeights(), *, oracle_fresh_s: float = 30, quote_fresh_ms: float = 900) -> DataFrame:
    """Weighted freshness ``quality``, weighted agreement ``conviction``, and the posterior rescaled by quality.

    Expects booleans ws_fresh, rest_fresh, leader_fresh, volume_ready next to the scored columns.
    """
    on = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    quality = (F.when(F.col("ws_fresh"), w.ws).when(F.col("rest_fresh"), w.rest).otherwise(0.0) + on(F.col("leader_fresh"), w.leader)
               + on(F.col("oracle_age_s") <= oracle_fresh_s, w.oracle) + on(F.col("quote_age_ms") <= quote_fresh_ms, w.quote)
               + on(F.col("volume_ready"), w.volume))
    up = F.col("side") == "Up"
    sgn = F.when(up, 1.0).otherwise(-1.0)
    unit = lambda x, off, sc: clamp((x + off) / sc, 0.0, 1.0)
    part = {
        "book": unit(F.col("dw_ob") * sgn, 0.2, 0.6), "taker": unit((F.col("taker_ratio") - 0.5) * sgn, 0.1, 0.25),
        "votes": clamp((F.col("tf_votes") - 1.0) / 3.0, 0.0, 1.0), "basis": unit(F.col("perp_basis") * sgn, 0.0003, 0.001),
        "vwap": unit(F.col("vwap_dev") * sgn, 0.001, 0.003), "oracle": on(F.col("cl_agree"), 1.0),
        "leader": F.when(F.col("leader_fresh"), unit(F.col("copy_net"), 0.2, 0.8)).otherwise(0.5),
        "binary": binary_d2_prob("current", "open_price", "mins_left", "vol", up)}
    conviction = F.lit(0.0)
    for k, v in w.conviction.items():
        conviction = conviction + part[k] * v
    s = s.withColumns({"quality": quality, "conviction": conviction})
    scale = w.scale_min + (w.scale_max - w.scale_min) * clamp("quality", 0.0, 1.0)
    s = s.withColumn("prob_up", clamp(0.5 + (F.col("prob_up") - 0.5) * scale, 0.05, 0.95))
    return s.withColumn("prob_down", 1.0 - F.col("prob_up"))


# ---------------------------------------------------------------- prediction blend
# Weights (base, trend, empirical, bucket) of each predictor for rounds of 15 minutes and for shorter ones.
BLEND = {
    "balanced": ((0.62, 0.23, 0.10, 0.05), (0.56, 0.28, 0.10, 0.05)),
    "momentum": ((0.50, 0.35, 0.10, 0.05), (0.45, 0.42, 0.10, 0.05)),
    "empirical": ((0.52, 0.16, 0.22, 0.10), (0.48, 0.20, 0.22, 0.10)),
}


def predict_blend(s: DataFrame, *, min_samples: int = 24) -> DataFrame:
    """Base, trend, empirical and bucket priors -> three predictors -> weights -> calibration -> shrink.

    Expects base_prob, score, analysis_quality, quote_age_ms, the side prior (n, wr_lb, expectancy as side_n,
    side_lb, side_exp), the bucket prior (bucket_n, bucket_lb, bucket_exp), the active variant with its
    sample count and calibration error (variant, variant_n, cal_err) and the weights w_balanced, w_momentum, w_empirical.
    Adds prob, prob_adj, edge_adj, score_adj.
    """
    long = F.col("duration") >= 15
    op, cur = F.col("open_price"), F.col("current")
    move = F.when((op > 0) & (cur > 0), (cur - op) / op).otherwise(0.0)
    ok = ((move >= 0) & (F.col("side") == "Up")) | ((move < 0) & (F.col("side") == "Down"))
    trend = 0.5 + F.when(ok, 0.08).otherwise(-0.08) * F.least(F.lit(1.0), F.abs(move) / 0.0025)
    left = F.col("mins_left")
    tw = clamp(F.when(long, 0.65).otherwise(0.55)
               + F.when(left <= 2.5, 0.10).when(left >= F.when(long, 10.0).otherwise(3.0), -0.05).otherwise(0.0), 0.35, 0.80)
    emp = F.when(F.col("side_n") >= min_samples, 0.5 + (F.col("side_lb") - 0.5) * 0.9
                 + F.when(F.col("side_exp") > 0.20, 0.015).when(F.col("side_exp") < -0.20, -0.015).otherwise(0.0)).otherwise(0.5)
    buck = F.when(F.col("bucket_n") >= min_samples // 2, 0.5 + (F.col("bucket_lb") - 0.5) * 0.7
                  + F.when(F.col("bucket_exp") > 0.20, 0.010).when(F.col("bucket_exp") < -0.20, -0.010).otherwise(0.0)).otherwise(0.5)
    s = s.withColumns({"_base": F.col("base_prob") * tw + 0.5 * (1.0 - tw), "_trend": trend, "_emp": emp, "_buck": buck})

    def mix(rows) -> Column:
        (a, b) = rows
        def term(w):
            return F.col("_base") * w[0] + F.col("_trend") * w[1] + F.col("_emp") * w[2] + F.col("_buck") * w[3]
        return clamp(F.when(long, term(a)).otherwise(term(b)), 0.05, 0.95)

    s = s.withColumns({f"p_{k}": mix(v) for k, v in BLEND.items()})
    blend = sum((F.col(f"p_{k}") * F.col(f"w_{k}") for k in list(BLEND)[1:]), F.col("p_balanced") * F.col("w_balanced"))
    active = F.when(F.col("variant") == "momentum", F.col("p_momentum")).when(F.col("variant") == "empirical", F.col("p_empirical")).otherwise(F.col("p_balanced"))
    p = blend * 0.70 + active * 0.30
    cut = clamp((F.col("cal_err") - 0.20) * 1.10, 0.0, 0.45)
    p = clamp(F.when(F.col("variant_n") < min_samples, p).otherwise(0.5 + (p - 0.5) * (1.0 - cut)), 0.05, 0.95)
    q = F.col("quote_age_ms")
    p = 0.5 + (p - 0.5) * F.when(q > 2200, 0.80).when(q > 1400, 0.90).when(q <= 700, 1.03).otherwise(1.0)
    p = 0.5 + (p - 0.5) * F.when(F.col("analysis_quality") < 0.45, 0.92).otherwise(1.0)
    s = s.withColumn("prob", clamp(p, 0.05, 0.95)).withColumn("prob_adj", F.round(F.col("prob") - F.col("base_prob"), 12))
    adj = F.col("prob_adj")
    pts = (F.when(adj >= 0.03, 1).when(adj <= -0.03, -1).otherwise(0)
           + F.when((F.col("side_n") >= 40) & (F.col("side_lb") >= 0.56) & (F.col("side_exp") > 0), 1).otherwise(0)
           - F.when((F.col("side_n") >= 40) & (F.col("side_lb") <= 0.46) & (F.col("side_exp") < 0), 1).otherwise(0)
           + F.when((F.col("score") >= 14) & (adj > 0), 1).otherwise(0)
           + F.when(q > 2200, -1).when((q <= 700) & (F.col("analysis_quality") >= 0.60) & (adj > 0), 1).otherwise(0))
    return s.withColumns({"edge_adj": adj * 0.65, "score_adj": F.least(F.lit(2), F.greatest(F.lit(-2), pts))}).drop("_base", "_trend", "_emp", "_buck")


# ---------------------------------------------------------------- flags
@dataclass(frozen=True)
class FlagConfig:
    """Limits of the flag rules; ours, to be tuned."""

    tail_max_entry: float = 0.35
    tail_min_left: float = 7.0
    tail_min_move: float = 0.0010
    lock_mins_5m: float = 1.0
    lock_mins_15m: float = 3.0
    lock_move: float = 0.0010
    align_left: float = 9.0
    align_move: float = 0.0010
    align_allow_score: int = 14
    align_allow_prob: float = 0.70
    align_score: int = 2
    align_edge: float = 0.010
    align_size: float = 0.60
    relax_pct_left: float = 0.35
    relax_move: float = 0.0012


def situation_flags(s: DataFrame, f: FlagConfig = FlagConfig()) -> DataFrame:
    """Contrarian tail, late direction lock, event alignment and late-locked flags with their effects."""
    up_p = F.col("up_price")
    cheap_side = _if(up_p <= 1.0 - up_p, "Up", "Down")
    move = (F.col("current") - F.col("open_price")) / F.greatest(F.col("open_price"), F.lit(1e-9))
    beat = _if(F.col("current") >= F.col("open_price"), "Up", "Down")
    ref = (F.col("open_price") > 0) & (F.col("current") > 0)
    tail = ((F.col("duration") >= 15) & (F.least(up_p, 1.0 - up_p) <= f.tail_max_entry) & (F.col("mins_left") >= f.tail_min_left)
            & (F.abs(move) >= f.tail_min_move) & (cheap_side != F.col("direction")))
    lock_m = F.when(F.col("duration") <= 5, f.lock_mins_5m).otherwise(f.lock_mins_15m)
    late = ref & F.col("duration").isin(5, 15) & (F.col("mins_left") <= lock_m) & (F.abs(move) >= f.lock_move) & (F.col("side") != beat)
    clear = ref & (F.col("duration") >= 15) & (F.col("mins_left") <= f.align_left) & (F.abs(move) >= f.align_move)
    contra = clear & (F.col("side") != beat) & ~((F.col("score") >= f.align_allow_score) & (F.col("true_prob") >= f.align_allow_prob))
    scale = clamp(F.abs(move) / f.align_move, 0.6, 1.4)
    side_up = F.col("side") == "Up"
    locked = (ref & (F.col("pct_remaining") <= f.relax_pct_left) & (F.col("duration") >= 15) & (F.abs(move) >= f.relax_move) & (F.col("side") == beat)
              & _if(side_up, F.col("taker_ratio") >= 0.52, F.col("taker_ratio") <= 0.48))
    pen = F.greatest(F.lit(1), F.bround(F.round(f.align_score * scale, 9), 0).cast("int"))
    no = lambda x: F.coalesce(x, F.lit(False))
    return s.withColumns({
        "contrarian_tail": no(tail), "late_lock": no(late), "event_contra": no(contra), "late_locked": no(locked),
        "flag_side": F.when(no(late), beat).when(no(tail), cheap_side).otherwise(F.col("side")),
        "flag_score": F.when(no(contra), -pen).otherwise(0) + F.when(no(late), -1).otherwise(0),
        "flag_edge": F.when(no(contra), -F.greatest(F.lit(0.004), f.align_edge * scale)).otherwise(0.0) + F.when(no(late), -0.004).otherwise(0.0),
        "flag_size_mult": F.when(no(contra), f.align_size).otherwise(1.0)})


# Weights of the add-on conviction parts; ours, to be tuned.
BOOSTER_WEIGHTS = {"votes": 0.25, "book": 0.20, "flow": 0.15, "volume": 0.10, "basis": 0.10, "vwap": 0.10, "oracle": 0.10}


def booster_conviction(weights: dict[str, float] | None = None) -> Column:
    """Conviction of an add-on: votes, book, flow, volume, basis, VWAP and oracle, positive parts only."""
    w = weights or BOOSTER_WEIGHTS
    sgn = F.when(F.col("side") == "Up", 1.0).otherwise(-1.0)
    pos = lambda x, sc: clamp(x / sc, 0.0, 1.0)
    part = {"votes": clamp((F.col("tf_votes") - 1.0) / 3.0, 0.0, 1.0), "book": pos(F.col("dw_ob") * sgn, 0.4),
            "flow": pos((F.col("taker_ratio") - 0.5) * sgn, 0.15), "volume": clamp((F.col("vol_ratio") - 1.0) / 1.0, 0.0, 1.0),
            "basis": pos(F.col("perp_basis") * sgn, 0.0008), "vwap": pos(F.col("vwap_dev") * sgn, 0.002),
            "oracle": F.when(F.col("cl_agree"), 1.0).otherwise(0.0)}
    out = F.lit(0.0)
    for k, v in w.items():
        out = out + part[k] * v
    return out


# ---------------------------------------------------------------- size modifiers
@dataclass(frozen=True)
class SizeConfig:
    """Ordered stake steps; limits are ours, to be tuned."""

    min_notional: float = 1.0
    super_entry: float = 0.15
    super_payout: float = 6.0
    super_min: float = 1.5
    super_max: float = 3.0
    super_bank_pct: float = 0.05
    super_score: int = 10
    super_ev: float = 0.05
    core_lo: float = 0.40
    core_hi: float = 0.55
    core_score: int = 10
    core_ev: float = 0.02
    core_bonus: float = 1.10
    contra_entry: float = 0.25
    contra_mult: float = 0.60
    contra_score: int = 13
    contra_ev: float = 0.05
    haircut_entry: float = 0.30
    haircut: float = 0.75
    haircut_keep_score: int = 14
    haircut_keep_prob: float = 0.70
    stack_decay: float = 0.70
    stack_min: float = 0.35
    round_decay: float = 0.85
    round_min: float = 0.45
    push: tuple[float, float, float] = (1.15, 1.0, 0.7)
    push_score: int = 13
    push_prob: float = 0.64
    push_ev: float = 0.03
    base_score: int = 9
    base_ev: float = 0.01
    fixed: float = 0.0
    max_size: float = 0.0


def size_modifiers(s: DataFrame, cfg: SizeConfig = SizeConfig()) -> DataFrame:
    """Stake after super-bet floor and cap, core / contrarian mix, alignment, haircut, round decay, push tier, fixed and max stake.

    Expects size, hard_cap, entry, score, true_prob, ev, cl_agree, bankroll, flag_size_mult, same_side_legs and
    round_legs of ``same_round_exposure``. Adds ``final_size`` and ``push_tier``. Applies to rounds of 15 minutes and more.
    """
    long = F.col("duration") >= 15
    cheap = long & (F.col("entry") <= cfg.super_entry) & (payout_mult("entry") >= cfg.super_payout)
    cap = F.col("hard_cap")
    floor_ok = cheap & (F.col("score") >= cfg.super_score) & (F.col("ev") >= cfg.super_ev)
    top = F.greatest(F.lit(0.50), F.least(F.lit(cfg.super_max), F.col("bankroll") * cfg.super_bank_pct))
    core = F.col("entry").between(cfg.core_lo, cfg.core_hi) & (F.col("score") >= cfg.core_score) & (F.col("ev") >= cfg.core_ev)
    strong_contra = (F.col("score") >= cfg.contra_score) & (F.col("ev") >= cfg.contra_ev)
    keep = (F.col("score") >= cfg.haircut_keep_score) & (F.col("true_prob") >= cfg.haircut_keep_prob)
    low = F.lit(cfg.min_notional)
    legs, both = F.col("same_side_legs"), F.col("round_legs")
    decay = lambda d, m, n: F.greatest(F.lit(m), F.pow(F.lit(d), n))
    push = (F.when((F.col("score") >= cfg.push_score) & (F.col("true_prob") >= cfg.push_prob) & (F.col("ev") >= cfg.push_ev) & F.col("cl_agree"), "push")
            .when((F.col("score") >= cfg.base_score) & (F.col("ev") >= cfg.base_ev), "base").otherwise("probe"))
    s = s.withColumn("push_tier", push)
    mult = F.when(F.col("push_tier") == "push", cfg.push[0]).when(F.col("push_tier") == "base", cfg.push[1]).otherwise(cfg.push[2])
    inf, zero = F.lit(float("inf")), F.lit(0.0)

    def scale(on: Column, m: Column | float, hi: Column = inf, lo: Column = low) -> Column:
        m = m if isinstance(m, Column) else F.lit(float(m))
        return F.struct(F.coalesce(on, F.lit(False)).alias("on"), m.cast("double").alias("mult"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def bound(on: Column, lo: Column = zero, hi: Column = inf) -> Column:
        return scale(on, F.lit(None), hi, lo)

    floor_step, cap_step = bound(floor_ok, lo=F.least(cap, F.lit(cfg.super_min))), bound(cheap, hi=top)
    contra = long & ~core & (F.col("entry") <= cfg.contra_entry) & ~strong_contra
    steps = [
        floor_step, cap_step,
        scale(long & core, cfg.core_bonus, cap, zero), scale(contra, cfg.contra_mult, cap),
        scale(long & (F.abs(F.col("flag_size_mult") - 1.0) > 1e-9), F.col("flag_size_mult"), cap),
        scale(long & (F.col("entry") <= cfg.haircut_entry) & ~keep, cfg.haircut),
        scale(long & (legs > 0), decay(cfg.stack_decay, cfg.stack_min, legs)),
        scale(long & (both > 0), decay(cfg.round_decay, cfg.round_min, both)),
        scale(F.abs(mult - 1.0) > 1e-9, mult, cap),
        floor_step, cap_step,
    ]
    if cfg.fixed > 0:
        steps.append(scale(F.lit(True), 0.0, lo=F.greatest(low, F.lit(round(cfg.fixed, 2)))))
    if cfg.max_size > 0:
        steps.append(scale(F.lit(True), 1.0, F.lit(cfg.max_size), zero))

    def apply(x: Column, st: Column) -> Column:
        bounded = F.when(x > st["hi"], round_to(st["hi"], 2)).otherwise(F.greatest(x, st["lo"]))
        scaled = F.greatest(round_to(F.least(x * st["mult"], st["hi"]), 2), st["lo"])
        return F.when(~st["on"], x).when(st["mult"].isNull(), bounded).otherwise(scaled)

    # A fold over the step array: chained columns would repeat the stake in every later expression.
    return s.withColumn("final_size", F.aggregate(F.array(*steps), F.col("size").cast("double"), apply))
