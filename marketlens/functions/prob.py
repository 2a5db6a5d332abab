"""Probability, sizing, fee and order-book functions as Spark Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, c, clamp, profit_factor, round_to, step

# Coefficients of the Abramowitz-Stegun 7.1.26 error-function polynomial.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Minutes per year in the two conventions.
TRADING_MINUTES = 252 * 24 * 60
CALENDAR_MINUTES = 525_600
# Share of a stake taken as fee at a price of one half.
FEE_RATE = 0.0156
FEE_FALLBACK = 0.0624


def norm_cdf(z: ColumnOrName) -> Column:
    """Standard normal CDF, absolute error below 1e-7 (Spark has no erf)."""
    x = F.abs(c(z)) / math.sqrt(2.0)
    t = F.lit(1.0) / (1.0 + ERF_P * x)
    poly = F.lit(ERF_A[4])
    for a in ERF_A[3::-1]:
        poly = poly * t + a
    erf = 1.0 - poly * t * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(c(z) < 0, -erf).otherwise(erf))


def prob_up(current: ColumnOrName, open_price: ColumnOrName, mins_left: ColumnOrName, vol: ColumnOrName) -> Column:
    """P(close >= open) for a driftless log-normal price; 0.5 on unusable input."""
    cur, op, m, v = (c(x).cast("double") for x in (current, open_price, mins_left, vol))
    good = (cur > 0) & (op > 0) & (m > 0) & (v > 0)
    years = F.greatest(m, F.lit(0.1)) / TRADING_MINUTES
    z = F.ln(cur / op) / (v * F.sqrt(years))
    return F.when(good, norm_cdf(F.when(good, z))).otherwise(F.lit(0.5))


def binary_d2_prob(current: ColumnOrName, open_price: ColumnOrName, mins_left: ColumnOrName, vol: ColumnOrName,
                   side_up: ColumnOrName | bool = True) -> Column:
    """N(d2) that the given side finishes in the money, calendar-minute years."""
    cur, op, m, v = (c(x).cast("double") for x in (current, open_price, mins_left, vol))
    up = F.lit(side_up) if isinstance(side_up, bool) else c(side_up)
    good = (cur > 0) & (op > 0) & (v > 0)
    years = F.greatest(m / CALENDAR_MINUTES, F.lit(1e-9))
    d2 = (F.ln(cur / op) - 0.5 * v * v * years) / (v * F.sqrt(years))
    z = F.when(good, F.when(up, d2).otherwise(-d2))
    return F.when(good, norm_cdf(z)).otherwise(F.lit(0.5))


def logistic(x: ColumnOrName, limit: float | None = None) -> Column:
    v = c(x) if limit is None else clamp(x, -limit, limit)
    return 1.0 / (1.0 + F.exp(-v))


def logit(p: ColumnOrName, floor: float = 1e-4) -> Column:
    return F.ln(F.greatest(c(p), F.lit(floor)) / F.greatest(1.0 - c(p), F.lit(floor)))


def platt(p: ColumnOrName, a: ColumnOrName | float, b: ColumnOrName | float) -> Column:
    """Platt recalibration; (1, 0) leaves the probability unchanged."""
    a, b = c(a), c(b)
    return F.when((a == 1.0) & (b == 0.0), c(p)).otherwise(clamp(logistic(a * logit(p) + b), 0.05, 0.95))


def shrink(p: ColumnOrName, k: ColumnOrName | float) -> Column:
    """Pull a probability towards one half."""
    return 0.5 + (c(p) - 0.5) * c(k)


def wilson_lb(wins: ColumnOrName, n: ColumnOrName, z: float = 1.0) -> Column:
    """Wilson lower bound of a win rate; 0.5 without samples."""
    n = c(n).cast("double")
    ph = F.try_divide(c(wins).cast("double"), n)
    z2 = z * z
    margin = z * F.sqrt(F.greatest(F.try_divide(ph * (1.0 - ph) + F.try_divide(F.lit(z2 / 4.0), n), n), F.lit(0.0)))
    lb = (ph + F.try_divide(F.lit(z2 / 2.0), n) - margin) / (1.0 + F.try_divide(F.lit(z2), n))
    return F.when(n > 0, clamp(lb, 0.0, 1.0)).otherwise(F.lit(0.5))


def kelly_size(p: ColumnOrName, entry: ColumnOrName, frac: ColumnOrName | float, bankroll: ColumnOrName | float,
               scale: ColumnOrName | float = 1.0, cap_pct: float = 0.35) -> Column:
    """Fractional-Kelly stake, capped, rounded to cents; 1 % of bankroll on an unusable entry."""
    e, bank = c(entry), c(bankroll)
    good = (e > 0) & (e < 1)
    b = 1.0 / F.when(good, e) - 1.0
    f = F.greatest(F.lit(0.0), (c(p) * b - (1.0 - c(p))) / b)
    sized = F.round(F.greatest(F.lit(0.0), F.least(bank * cap_pct, bank * f * c(frac) * c(scale))), 2)
    return F.when(good, sized).otherwise(F.greatest(F.lit(0.0), bank * 0.01))


def fee_stake(size: ColumnOrName, price: ColumnOrName, rate: float = FEE_RATE) -> Column:
    """Fee in currency: largest at one half, zero at 0 and 1."""
    return c(size) * rate * (1.0 - F.abs(c(price) - 0.5) * 2.0)


def fee_ratio(price: ColumnOrName, rate: ColumnOrName | float = 0.0, exponent: float = 2.0) -> Column:
    """Fee per unit of value, or the fallback curve when no rate is known."""
    p = clamp(price, 0.0, 1.0)
    base = F.greatest(F.lit(0.0), p * (1.0 - p))
    return F.when(c(rate) > 0, F.greatest(F.lit(0.0), c(rate) * F.pow(base, F.lit(float(exponent))))).otherwise(
        F.greatest(F.lit(0.001), base * FEE_FALLBACK))


def payout_mult(entry: ColumnOrName) -> Column:
    return 1.0 / F.greatest(c(entry), F.lit(1e-9))


def ev_net(p: ColumnOrName, entry: ColumnOrName, fee: ColumnOrName | float = FEE_RATE) -> Column:
    return c(p) / F.greatest(c(entry), F.lit(1e-9)) - 1.0 - c(fee)


def edge(p: ColumnOrName, price: ColumnOrName) -> Column:
    return c(p) - c(price)


def model_cap(p: ColumnOrName, min_ev: ColumnOrName | float, fee: float = FEE_RATE) -> Column:
    """Dearest entry at which the expected value still clears its floor."""
    return c(p) / (1.0 + fee + F.greatest(F.lit(0.003), c(min_ev)))


def ev_frontier_prob(entry: ColumnOrName, fee: ColumnOrName | float, margin: float, high_margin: float) -> Column:
    """Least probability wanted at an entry: break-even plus a margin growing above one half."""
    e = c(entry)
    return e * (1.0 + c(fee)) + margin + F.greatest(F.lit(0.0), e - 0.50) * high_margin


def pnl_binary(won: ColumnOrName, size: ColumnOrName, entry: ColumnOrName) -> Column:
    return F.when(c(won), c(size) * (1.0 / c(entry) - 1.0)).otherwise(-c(size))


def unrealised_pnl(size: ColumnOrName, entry: ColumnOrName, live_price: ColumnOrName) -> Column:
    """Mark-to-market of an open position at the live token price."""
    return c(size) * (c(live_price) / c(entry) - 1.0)


def slip_bps(exec_price: ColumnOrName, ref_price: ColumnOrName) -> Column:
    return (c(exec_price) - c(ref_price)) / F.greatest(c(ref_price), F.lit(1e-9)) * 10000.0


def book_depth_usdc(levels: ColumnOrName, price_cap: ColumnOrName | float) -> Column:
    """Value resting at or below a price, reading levels in order up to the first dearer one."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(False).alias("stop"))

    def take(acc: Column, lv: Column) -> Column:
        stop = acc["stop"] | (lv["price"] > c(price_cap) + 1e-9)
        return F.struct(F.when(stop, acc["d"]).otherwise(acc["d"] + lv["price"] * lv["size"]).alias("d"),
                        stop.alias("stop"))

    return F.aggregate(c(levels), start, take, lambda acc: acc["d"])


def order_size(px: ColumnOrName, usdc: ColumnOrName, *, min_shares: float = 5.0, pad_shares: float = 0.02,
               min_notional: float = 1.0, max_notional: float = 0.0) -> Column:
    """struct(shares, notional): minimum shares, cent ceiling; shares 0 where the cap cannot hold."""
    p = F.greatest(c(px), F.lit(1e-9))
    floor_usdc = F.greatest(F.lit(min_notional), F.lit(max(0.01, min_shares + pad_shares)) * p)
    shares = F.greatest(F.greatest(F.lit(0.0), c(usdc)) / p, floor_usdc / p)
    shares = F.floor(shares * 100.0 + 0.999999) / 100.0
    notional = shares * p
    ok = F.struct(shares.alias("shares"), round_to(notional, 2).alias("notional"))
    if max_notional <= 0:
        return ok
    none = lambda v: F.struct(F.lit(0.0).alias("shares"), v.alias("notional"))
    cap = max_notional + 1e-6
    return F.when(floor_usdc > cap, none(floor_usdc)).when(notional > cap, none(notional)).otherwise(ok)


def growth_score(entry: ColumnOrName, score: ColumnOrName, edge_: ColumnOrName, true_prob: ColumnOrName,
                 oracle_agree: ColumnOrName, quote_age_ms: ColumnOrName, latency_ms: ColumnOrName) -> Column:
    """Rank of a candidate: net EV, edge, payout, score, oracle agreement, freshness."""
    e = F.greatest(c(entry), F.lit(1e-6))
    return (c(true_prob) / e - 1.0 - FEE_RATE + c(edge_) * 0.35 + (1.0 / e - 1.0) * 0.06 + c(score) * 0.003
            + F.when(c(oracle_agree), F.lit(0.02)).otherwise(F.lit(-0.03))
            + F.when(c(quote_age_ms) > 900, F.lit(-0.03)).otherwise(F.lit(0.0))
            + F.when(c(latency_ms) > 550, F.lit(-0.03)).otherwise(F.lit(0.0)))


# Kelly fraction and bankroll share by entry price (rows) and score (>=12, >=8, else).
ENTRY_TIERS = (
    (0.20, ((0.20, 0.10), (0.16, 0.08), (0.12, 0.06))),
    (0.30, ((0.16, 0.08), (0.12, 0.06), (0.10, 0.05))),
    (0.40, ((0.12, 0.06), (0.10, 0.05), (0.08, 0.04))),
    (0.55, ((0.08, 0.04), (0.06, 0.03), (0.05, 0.025))),
    (None, ((0.04, 0.02), (0.03, 0.015), (0.02, 0.010))),
)


def entry_tier(entry: ColumnOrName, score: ColumnOrName) -> tuple[Column, Column]:
    """(kelly_frac, bankroll_pct) of the 5 x 3 tier table."""
    def pick(i: int) -> Column:
        rows = [(lim, step(score, ((12, r[0][i]), (8, r[1][i])), r[2][i])) for lim, r in ENTRY_TIERS]
        return step(entry, rows[:-1], rows[-1][1], op="le")
    return pick(0), pick(1)


def bucket_size_scale(outcomes: ColumnOrName, pnl: ColumnOrName, gross_win: ColumnOrName, gross_loss: ColumnOrName,
                      fills: ColumnOrName, slip_sum: ColumnOrName) -> Column:
    """Stake multiplier from a bucket's realised quality."""
    n = F.coalesce(c(outcomes), F.lit(0))
    pf = profit_factor(gross_win, gross_loss)
    exp = c(pnl) / F.greatest(n, F.lit(1))
    slip = c(slip_sum) / F.greatest(c(fills), F.lit(1))
    s = (F.when((n >= 12) & ((pf < 0.90) | (exp < -0.25)), F.lit(0.45))
         .when((pf < 1.05) | (exp < 0.0), F.lit(0.70))
         .when((pf > 1.35) & (exp > 0.30) & (slip < 120.0), F.lit(1.15)).otherwise(F.lit(1.0)))
    s = s * F.when(slip > 350.0, F.lit(0.75)).otherwise(F.lit(1.0))
    return F.when(n < 8, F.lit(1.0)).otherwise(clamp(s, 0.40, 1.20))


def _tightness(n: Column, pf: Column, exp: Column, slip: Column, losses: Column) -> Column:
    zero = F.lit(0.0)
    t = (F.when((n >= 10) & (pf < 1.0), F.least(F.lit(1.2), (1.0 - pf) * 1.5)).otherwise(zero)
         + F.when((n >= 10) & (exp < 0), F.least(F.lit(1.0), F.abs(exp) / 0.8)).otherwise(zero)
         + F.when(slip > 220, F.least(F.lit(0.6), (slip - 220.0) / 600.0)).otherwise(zero)
         + F.when(losses >= 2, F.least(F.lit(1.0), (losses - 1) * 0.25)).otherwise(zero)
         - F.when((n >= 12) & (pf > 1.35) & (exp > 0.30) & (slip < 120), F.lit(0.35)).otherwise(zero))
    return clamp(t, -0.5, 1.8)


def adaptive_thresholds(minutes: ColumnOrName, outcomes: ColumnOrName, pf: ColumnOrName, expectancy: ColumnOrName,
                        avg_slip: ColumnOrName, consec_losses: ColumnOrName) -> tuple[Column, Column, Column]:
    """(min payout, min EV, max entry), tightened while realised quality is poor."""
    five = c(minutes) <= 5
    t = _tightness(c(outcomes), c(pf), c(expectancy), c(avg_slip), c(consec_losses))
    base_payout = F.when(five, F.lit(1.75)).otherwise(F.lit(1.85))
    hard_cap = F.when(five, F.lit(0.54)).otherwise(F.lit(0.65))
    return (F.greatest(F.lit(1.55), base_payout + 0.20 * t),
            F.greatest(F.lit(0.005), 0.018 + 0.015 * t),
            clamp(hard_cap - 0.06 * t, 0.33, 0.80))


def prob_shrink(outcomes: ColumnOrName, pf: ColumnOrName, expectancy: ColumnOrName, avg_slip: ColumnOrName,
                consec_losses: ColumnOrName) -> Column:
    """Confidence multiplier learnt from realised quality."""
    n, pf, exp, slip, losses = (c(x) for x in (outcomes, pf, expectancy, avg_slip, consec_losses))
    zero = F.lit(0.0)
    s = (0.82
         - F.when(pf < 1.0, F.least(F.lit(0.25), (1.0 - pf) * 0.50)).otherwise(zero)
         - F.when(exp < 0, F.least(F.lit(0.20), F.abs(exp))).otherwise(zero)
         - F.when(slip > 240, F.least(F.lit(0.10), (slip - 240.0) / 900.0)).otherwise(zero)
         + F.when((pf > 1.40) & (exp > 0.20) & (slip < 120), F.lit(0.05)).otherwise(zero)
         - F.when(losses >= 2, F.least(F.lit(0.15), losses * 0.04)).otherwise(zero))
    return F.when(n < 8, F.lit(0.75)).otherwise(clamp(s, 0.40, 0.92))


def adaptive_min_edge(outcomes: ColumnOrName, pf: ColumnOrName, expectancy: ColumnOrName,
                      avg_slip: ColumnOrName) -> Column:
    n, pf, exp, slip = (c(x) for x in (outcomes, pf, expectancy, avg_slip))
    zero = F.lit(0.0)
    e = (0.045
         + F.when(slip > 250, F.least(F.lit(0.015), (slip - 250.0) / 25000.0)).otherwise(zero)
         + F.when((n >= 10) & (pf < 1.0), F.least(F.lit(0.015), (1.0 - pf) * 0.03)).otherwise(zero)
         - F.when((n >= 10) & (pf > 1.35) & (exp > 0.2), F.lit(0.008)).otherwise(zero))
    return clamp(e, 0.03, 0.08)


def drawdown_scale(dd: ColumnOrName) -> Column:
    """Stake multiplier by relative drawdown."""
    return step(dd, ((0.10, 1.0), (0.20, 0.60), (0.30, 0.35)), 0.20, op="lt")


def direction_bias(n: ColumnOrName, gross_win: ColumnOrName, gross_loss: ColumnOrName, pnl: ColumnOrName) -> Column:
    """Additive probability bias from one side's realised results."""
    pf = profit_factor(gross_win, gross_loss)
    b = (pf - 1.0) * 0.02 + c(pnl) / F.greatest(c(n), F.lit(1)) / 8.0
    return F.when(c(n) < 8, F.lit(0.0)).otherwise(clamp(b, -0.06, 0.06))


def book_imbalance(bids: ColumnOrName, asks: ColumnOrName, levels: int = 10) -> Column:
    """(bid - ask) / (bid + ask) over the first ``levels`` sizes; 0 for an empty book."""
    tot = lambda a: F.aggregate(F.slice(c(a), 1, levels), F.lit(0.0), lambda s, x: s + x)
    b, a = tot(bids), tot(asks)
    return F.when(b + a == 0, F.lit(0.0)).otherwise(F.try_divide(b - a, b + a))


def book_depth_weighted(bids: ColumnOrName, asks: ColumnOrName, levels: int = 20) -> Column:
    """Imbalance with each level weighted by 1 / rank."""
    def tot(a: ColumnOrName) -> Column:
        ranked = F.transform(F.slice(c(a), 1, levels), lambda x, i: x / (i + 1))
        return F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x)
    b, a = tot(bids), tot(asks)
    return F.when(b + a == 0, F.lit(0.0)).otherwise(F.try_divide(b - a, b + a))


def best_quotes(bids: ColumnOrName, asks: ColumnOrName) -> tuple[Column, Column]:
    """(best bid, best ask) of struct<price,size> arrays; an empty bid side is ask - 0.10."""
    ask = F.array_min(F.transform(c(asks), lambda lv: lv["price"]))
    bid = F.array_max(F.transform(c(bids), lambda lv: lv["price"]))
    return F.when(ask.isNotNull(), F.coalesce(bid, ask - 0.10)), ask


def perp_basis(mark: ColumnOrName, index: ColumnOrName) -> Column:
    return F.round(F.when(c(index) > 0, F.try_divide(c(mark) - c(index), c(index))).otherwise(F.lit(0.0)), 7)
