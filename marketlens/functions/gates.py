"""Gates as one reason column: the first failing rule, in fixed order, or ``ok``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ColumnOrName, c, first_reason
from .prob import ev_frontier_prob, payout_mult


def core_gate_reason(*, min_score: ColumnOrName | float, min_payout: ColumnOrName | float,
                     min_ev: ColumnOrName | float, score: ColumnOrName = "score",
                     payout: ColumnOrName = "payout_mult", ev: ColumnOrName = "execution_ev") -> Column:
    return first_reason([
        (c(score) < c(min_score), "score_below"),
        (c(payout) < c(min_payout), "payout_below"),
        (c(ev) < c(min_ev), "ev_below"),
    ])


@dataclass(frozen=True)
class DecideConfig:
    """Duration-aware gate limits and stake fraction."""

    min_score_15m: int = 0
    min_score_5m: int = 0
    min_ev_15m: float = 0.010
    min_ev_5m: float = 0.015
    min_payout_15m: float = 1.72
    min_payout_5m: float = 1.75
    risk_fraction: float = 0.025
    min_notional: float = 1.0


def decide(signals: DataFrame, bankroll: ColumnOrName | float, cfg: DecideConfig = DecideConfig()) -> DataFrame:
    """Adds ``reason`` and ``notional_usdc`` (null where blocked)."""
    five = F.col("duration") <= 5
    by_dur = lambda a, b: F.when(five, F.lit(a)).otherwise(F.lit(b))
    reason = core_gate_reason(min_score=by_dur(cfg.min_score_5m, cfg.min_score_15m),
                              min_payout=by_dur(cfg.min_payout_5m, cfg.min_payout_15m),
                              min_ev=by_dur(cfg.min_ev_5m, cfg.min_ev_15m))
    notional = F.greatest(F.lit(cfg.min_notional), c(bankroll) * cfg.risk_fraction)
    return signals.withColumn("reason", reason).withColumn(
        "notional_usdc", F.when(F.col("reason") == "ok", notional))


def snapshot_gate_reason(*, max_quote_age_ms: float = 1200.0, min_pct_left: float = 0.15,
                         max_oracle_age_s: float = 90.0, strict_source: bool = True,
                         contra_book: float = -0.40) -> Column:
    """Pre-score funnel over a snapshot row (columns as produced by ``plans.scoring``)."""
    rules = [
        (F.col("current") <= 0, "no_price"),
        (F.col("quote_age_ms") > max_quote_age_ms, "quote_stale"),
        (F.col("open_price").isNull() | (F.col("open_price") <= 0), "no_open_price"),
        (F.col("pct_remaining") < min_pct_left, "too_late"),
        (F.col("direction").isNull(), "no_direction"),
    ]
    if strict_source:
        rules.append((F.col("open_src") != "PM", "open_source"))
    rules += [
        (F.col("oracle_age_s") > max_oracle_age_s, "oracle_stale"),
        (F.col("jump_dir").isNotNull() & (F.col("jump_dir") != F.col("direction")), "jump_against"),
        (F.col("ob_sig") < contra_book, "book_against"),
    ]
    return first_reason(rules)


def high_win_reason(*, min_prob_5m: float = 0.58, min_prob_15m: float = 0.60, min_edge: float = 0.015,
                    require_agree: bool = True) -> Column:
    need = F.when(F.col("duration") <= 5, F.lit(min_prob_5m)).otherwise(F.lit(min_prob_15m))
    rules = [(~F.col("cl_agree"), "oracle_disagree")] if require_agree else []
    return first_reason(rules + [(F.col("true_prob") < need, "prob_low"), (F.col("edge") < min_edge, "edge_low")])


def execution_filter_reason(*, min_left_5m: float = 1.2, min_left_15m: float = 1.2, max_quote_ms: float = 1200.0,
                            max_latency_ms: float = 1200.0, lock_mins_5m: float = 1.0, lock_mins_15m: float = 3.0,
                            lock_move: float = 0.0010, min_score_5m: int = 8, min_score_15m: int = 6,
                            extra_btc_5m: int = 1, extra_xrp_15m: int = 0) -> Column:
    """Last checks before an order: time left, late direction lock, extra score, staleness, latency.

    Late-lock limits are parameters; quote age and latency block only at 3x and 2x their caps.
    """
    five = F.col("duration") <= 5
    lock = F.when(five, F.lit(lock_mins_5m)).otherwise(F.lit(lock_mins_15m))
    beat = F.when(F.col("current") >= F.col("open_price"), F.lit("Up")).otherwise(F.lit("Down"))
    move = F.abs((F.col("current") - F.col("open_price")) / F.greatest(F.col("open_price"), F.lit(1e-9)))
    extra = (F.when((F.col("asset") == "BTC") & five, F.lit(extra_btc_5m))
             .when((F.col("asset") == "XRP") & ~five, F.lit(extra_xrp_15m)).otherwise(F.lit(0)))
    base = F.when(five, F.lit(min_score_5m)).otherwise(F.lit(min_score_15m))
    return first_reason([
        (F.col("mins_left") <= F.when(five, F.lit(min_left_5m)).otherwise(F.lit(min_left_15m)), "mins_left"),
        (F.col("duration").isin(5, 15) & (F.col("open_price") > 0) & (F.col("current") > 0)
         & (F.col("mins_left") <= lock) & (move >= lock_move) & (F.col("side") != beat), "late_lock"),
        ((extra > 0) & (F.col("score") < base + extra), "extra_score"),
        (F.col("quote_age_ms") > max_quote_ms * 3, "quote_very_stale"),
        (F.col("signal_latency_ms") > max_latency_ms * 2, "latency_extreme"),
    ])


def bucket_block_reason(*, min_outcomes_5m: int = 10, max_pf_5m: float = 0.9, max_wr_5m: float = 0.45,
                        max_pnl_5m: float = -5.0, min_outcomes_15m: int = 20, max_pf_15m: float = 0.8,
                        max_wr_15m: float = 0.40) -> Column:
    """Refuses buckets with mature bad results; expects the bucket_stats columns on the row."""
    n = F.coalesce(F.col("outcomes"), F.lit(0))
    wr = F.coalesce(F.try_divide(F.col("wins").cast("double"), n), F.lit(0.0))
    pf = (F.when(F.col("gross_loss") > 1e-9, F.try_divide(F.col("gross_win"), F.col("gross_loss")))
          .when(F.col("gross_win") > 0, F.lit(99.0)).otherwise(F.lit(0.0)))
    bad5 = ((F.col("duration") == 5) & (n >= min_outcomes_5m)
            & (((pf <= max_pf_5m) & (wr <= max_wr_5m)) | (F.col("pnl") <= max_pnl_5m)))
    bad15 = (F.col("duration") >= 15) & (n >= min_outcomes_15m) & (pf <= max_pf_15m) & (wr <= max_wr_15m)
    return first_reason([(bad5 | bad15, "bucket_pf_blocked")])


@dataclass(frozen=True)
class ConsistencyConfig:
    """Limits of the 15-minute consistency gates; the values are ours, to be tuned."""

    min_prob: float = 0.55
    min_ev: float = 0.015
    min_payout: float = 1.60
    max_entry: float = 0.60
    strong_score: int = 12
    strong_prob: float = 0.66
    strong_ev: float = 0.03
    trail_min_pct_left: float = 0.50
    frontier_margin: float = 0.01
    frontier_high_margin: float = 0.10


def consistency_reason(cfg: ConsistencyConfig = ConsistencyConfig(), *, prob_add: ColumnOrName | float = 0.0,
                       ev_add: ColumnOrName | float = 0.0, fee: ColumnOrName | float = "fee_ratio") -> Column:
    e, p, ev = F.col("entry"), F.col("true_prob"), F.col("execution_ev")
    up = F.col("side") == "Up"
    lead = (up & (F.col("current") >= F.col("open_price"))) | (~up & (F.col("current") < F.col("open_price")))
    strong = ((F.col("score") >= cfg.strong_score) & (p >= cfg.strong_prob) & (ev >= cfg.strong_ev)
              & (F.col("tf_votes") >= 3) & F.col("cl_agree"))
    floor_p = F.greatest(F.lit(0.50), F.least(F.lit(0.90), cfg.min_prob + c(prob_add)))
    floor_ev = F.greatest(F.lit(0.005), F.least(F.lit(0.060), cfg.min_ev + c(ev_add)))
    need = ev_frontier_prob(e, fee, cfg.frontier_margin, cfg.frontier_high_margin)
    r = first_reason([
        (p + 1e-9 < need, "ev_frontier_prob_low"),
        (payout_mult(e) + 1e-9 < max(1.30, cfg.min_payout), "consistency_payout_low"),
        (~F.col("cl_agree"), "consistency_cl_disagree"),
        (p + 1e-9 < floor_p, "consistency_prob_low"),
        (ev + 1e-9 < floor_ev, "consistency_ev_low"),
        ((e > cfg.max_entry) & ~strong, "consistency_entry_high"),
        (~lead & ~((F.col("pct_remaining") >= cfg.trail_min_pct_left) & strong), "consistency_trail_weak"),
    ])
    return F.when(F.col("duration") >= 15, r).otherwise(F.lit("ok"))


def lowcent_reason(*, threshold: float = 0.20, min_score: int = 12, min_prob: float = 0.40, min_ev: float = 0.05,
                   min_payout: float = 4.0, only_addon: bool = False) -> Column:
    """Very cheap entries: add-ons must lead, first entries need an exceptional setup."""
    cheap = F.col("entry") <= threshold
    up = F.col("side") == "Up"
    lead = (up & (F.col("current") > F.col("open_price"))) | (~up & (F.col("current") < F.col("open_price")))
    if only_addon:
        return first_reason([(cheap & ~F.col("is_addon"), "lowcent_requires_existing"),
                             (cheap & ~lead, "lowcent_not_leading")])
    strong = ((F.col("duration") >= 15) & (F.col("score") >= min_score) & (F.col("true_prob") >= min_prob)
              & (F.col("execution_ev") >= min_ev) & (F.col("payout_mult") >= min_payout) & F.col("cl_agree"))
    return first_reason([(cheap & ~F.col("is_addon") & ~strong, "lowcent_new_weak")])


def regime_bucket_reason(*, duration: int = 5, score_min: int = 0, score_max: int = 99, entry_min: float = 0.05,
                         early_max: float = 0.40, late_max: float = 0.30, late_mins: float = 2.0) -> Column:
    """Keeps one duration, score band and entry band; the entry cap drops near expiry."""
    cap = F.when(F.col("mins_left") <= late_mins, F.lit(min(early_max, late_max))).otherwise(F.lit(early_max))
    return first_reason([
        (F.col("duration") != duration, "duration"),
        (~F.col("score").between(score_min, score_max), "score"),
        (~((F.col("entry") >= entry_min) & (F.col("entry") < cap)), "entry"),
    ])


def lowcent_window(*, from_s: float = 60.0, to_s: float = 265.0, entry_min: float = 0.08,
                   entry_max: float = 0.30) -> tuple[Column, Column]:
    """(inside the elapsed window, entry clipped into the half-open price band)."""
    elapsed = F.greatest(F.lit(0.0), F.col("duration") * 60.0 - F.col("mins_left") * 60.0)
    clipped = F.greatest(F.lit(entry_min), F.least(F.col("entry"), F.lit(entry_max - 1e-6)))
    return elapsed.between(from_s, to_s), clipped
