"""Time-series features over bars and ticks.

Feature builders are plain Columns over a window that spans a key's recent rows. ``BarFrame``
prepares that window once (``ordered.lookback``), so any number of features share one pass:

    f = BarFrame(bars)
    f.with_features(sigma=f.rms_sigma(14), park=f.parkinson_vol(30))
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import clamp, div_or, epoch_us, round_to, step
from ..functions.prob import TRADING_MINUTES, norm_cdf
from .asof import asof_backward
from .ordered import CHUNK, OWN, PART, add_chunk, block_window, lookback, own_rows, running, time_halo, with_part

# Annualised volatility steps and the stake multiplier of each.
VOL_REGIMES = ((0.40, 0.7), (0.80, 1.0), (1.50, 1.2))
VOL_REGIME_TOP = 1.4
DAY_S = 86_400


class BarFrame:
    """Bars with every frame of up to ``n`` preceding rows available.

    Expects columns asset, ts, o, h, l, c, v, taker_v (only those a feature uses).
    """

    def __init__(self, bars: DataFrame, keys: Sequence[str] = ("asset",), ts: str = "ts", n: int = 33, *,
                 width_s: float | None = None, block: int = 65_536):
        self.keys = list(keys)
        self.df = lookback(bars, self.keys, [ts], n, ts=ts, width_s=width_s, block=block)
        self.w = block_window(self.keys)
        prev = F.lag("c").over(self.w)
        self.df = self.df.withColumns({"_ret": div_or(F.col("c") - prev, F.when(prev > 0, prev), None),
                                       "_lret": F.when((prev > 0) & (F.col("c") > 0), F.ln(F.col("c") / prev))})

    def rows(self, back: int, to: int = 0) -> Window:
        return self.w.rowsBetween(-back, to)

    def with_features(self, **features: Column) -> DataFrame:
        return own_rows(self.df.withColumns(features)).drop("_ret", "_lret")

    # -- returns and volatility
    def simple_return(self) -> Column:
        return F.col("_ret")

    def log_return(self) -> Column:
        return F.col("_lret")

    def bars_seen(self, n: int) -> Column:
        return F.count("c").over(self.rows(n - 1))

    def rms_sigma(self, n: int = 14) -> Column:
        """Root mean square return over the last ``n`` closes, floored at 1e-8 (not centred)."""
        return F.greatest(F.sqrt(F.avg(F.col("_ret") * F.col("_ret")).over(self.rows(n - 2))), F.lit(1e-8))

    def annual_vol(self, n: int = 33) -> Column:
        return F.sqrt(F.avg(F.col("_lret") * F.col("_lret")).over(self.rows(n - 2))) * math.sqrt(TRADING_MINUTES)

    def parkinson_vol(self, n: int = 30) -> Column:
        """High-low volatility, annualised, clamped to [0.1, 5]; bars without a range are left out."""
        x = F.when((F.col("l") > 0) & (F.col("h") > F.col("l")), F.pow(F.ln(F.col("h") / F.col("l")), F.lit(2.0)))
        var = F.avg(x).over(self.rows(n - 1)) / (4.0 * math.log(2.0))
        return F.when(var.isNotNull(), clamp(F.sqrt(var * TRADING_MINUTES), 0.10, 5.0))

    def vol_regime_mult(self, n: int = 33) -> Column:
        ann = F.avg(F.abs("_ret")).over(self.rows(n - 2)) * math.sqrt(TRADING_MINUTES)
        return F.when(ann.isNull(), F.lit(1.0)).otherwise(step(ann, VOL_REGIMES, VOL_REGIME_TOP, op="lt"))

    # -- trend
    def displacement(self, n: int = 12) -> Column:
        """Relative change over min(n, available - 1) bars."""
        first = F.first("c").over(self.rows(n))
        return div_or(F.col("c") - first, F.when(first > 0, first), None)

    def kline_trend(self, n: int, sigma_15m: Column | float, minutes: float) -> Column:
        """Displacement over ``n`` bars in units of sigma over the same time; 0 below 4 bars."""
        s = F.lit(sigma_15m) if isinstance(sigma_15m, float) else sigma_15m
        enough = (self.bars_seen(n + 1) >= 4) & (s > 0)
        return F.when(enough, self.displacement(n) / (s * math.sqrt(minutes / 15.0))).otherwise(F.lit(0.0))

    def autocorr(self, n: int = 32) -> Column:
        """Lag-1 autocorrelation of the last ``n`` closes' returns about their mean; 0 below 4 returns."""
        r, w = F.col("_ret"), self.rows(n - 2)
        k, s1, s2 = F.count(r).over(w), F.sum(r).over(w), F.sum(r * r).over(w)
        mu = s1 / k
        first, last = F.first(r, True).over(w), F.last(r, True).over(w)
        cross = F.sum("_rr").over(self.rows(n - 3))
        num = cross - mu * (2.0 * s1 - first - last) + (k - 1) * mu * mu
        den = s2 - k * mu * mu
        return F.when((k >= 4) & (den > 0), F.try_divide(num, den)).otherwise(F.lit(0.0))

    def with_pair_products(self) -> BarFrame:
        """Adds the product of neighbouring returns that ``autocorr`` sums."""
        self.df = self.df.withColumn("_rr", F.col("_ret") * F.lag("_ret").over(self.w))
        return self

    def variance_ratio(self, q: int = 5, n: int = 33) -> Column:
        """Variance of q-bar returns over q times the 1-bar variance; 1 below 4q + 2 closes."""
        r, w1, wq = F.col("_lret"), self.rows(n - 2), self.rows(n - 1 - q)
        rq = F.col(f"_lret{q}")
        closes = F.count("c").over(self.rows(n - 1))
        k, s1, s2 = F.count(r).over(w1), F.sum(r).over(w1), F.sum(r * r).over(w1)
        mu = s1 / k
        var1 = (s2 - k * mu * mu) / (k - 1)
        m, t1, t2 = F.count(rq).over(wq), F.sum(rq).over(wq), F.sum(rq * rq).over(wq)
        varq = (t2 - 2.0 * q * mu * t1 + m * (q * q) * mu * mu) / ((m - 1) * q)
        return F.when(closes < 4 * q + 2, F.lit(1.0)).otherwise(
            F.when(var1 > 1e-300, F.try_divide(varq, var1)).otherwise(F.lit(1.0)))

    def with_q_returns(self, q: int = 5) -> BarFrame:
        """Adds the q-bar log return that ``variance_ratio`` uses."""
        prev = F.lag("c", q).over(self.w)
        self.df = self.df.withColumn(f"_lret{q}", F.when((prev > 0) & (F.col("c") > 0), F.ln(F.col("c") / prev)))
        return self

    # -- flow
    def taker_flow(self, recent: int = 3, n: int = 33) -> tuple[Column, Column]:
        """(taker share of the last bars, their mean volume over the mean of the earlier ones)."""
        w, h = self.rows(recent - 1), self.rows(n - 1, -recent)
        few = self.bars_seen(n) < recent + 1
        vol, hist = F.sum("v").over(w), F.avg("v").over(h)
        share = F.when(vol > 0, F.try_divide(F.sum("taker_v").over(w), vol)).otherwise(F.lit(0.5))
        ratio = F.when(hist > 0, F.try_divide(vol / recent, hist)).otherwise(F.lit(1.0))
        return (F.when(few, F.lit(0.5)).otherwise(round_to(share, 3)),
                F.when(few, F.lit(1.0)).otherwise(round_to(ratio, 2)))

    def smooth(self, col: str, n: int = 12, need: int = 3) -> Column:
        """Mean of the last ``n`` values once ``need`` have been seen, else the value itself."""
        w = self.rows(n - 1)
        return F.when(F.count(col).over(self.rows(max(n, need) - 1)) >= need, F.avg(col).over(w)).otherwise(F.col(col))

    # -- oscillators (textbook definitions)
    def rsi(self, n: int = 14) -> Column:
        prev = F.col("c") - F.col("_prev_c")
        up = F.avg(F.greatest(prev, F.lit(0.0))).over(self.rows(n - 1))
        dn = F.avg(F.greatest(-prev, F.lit(0.0))).over(self.rows(n - 1))
        return F.when(F.count("_prev_c").over(self.rows(n - 1)) < n, F.lit(50.0)).otherwise(
            F.when(up + dn == 0, F.lit(50.0)).otherwise(F.try_divide(100.0 * up, up + dn)))

    def with_prev_close(self) -> BarFrame:
        self.df = self.df.withColumn("_prev_c", F.lag("c").over(self.w))
        return self

    def williams_r(self, n: int = 14) -> Column:
        hi, lo = F.max("h").over(self.rows(n - 1)), F.min("l").over(self.rows(n - 1))
        full = self.bars_seen(n) >= n
        return F.when(full & (hi > lo), F.try_divide(hi - F.col("c"), hi - lo) * -100.0).otherwise(F.lit(-50.0))

    def delta(self, col: str) -> Column:
        """Relative change to the previous value; null without a positive one."""
        prev = F.lag(col).over(self.w)
        return div_or(F.col(col) - prev, F.when(prev > 0, prev), None)


def window_vwap(bars: DataFrame, round_s: float, keys: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """Volume-weighted typical price since the round start, and the close's deviation from it.

    A round is a natural chunk: one window partition holds one round of one key.
    """
    slot = F.floor(epoch_us(ts) / int(round_s * 1e6))
    w = Window.partitionBy(*keys, "_slot").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3.0
    tv, v = F.sum(typical * F.col("v")).over(w), F.sum("v").over(w)
    vwap = F.when(v > 0, F.try_divide(tv, v)).otherwise(F.col("c"))
    return (bars.withColumn("_slot", slot).withColumn("vwap", vwap).drop("_slot")
            .withColumn("vwap_dev", round_to(F.when(F.col("vwap") > 0, F.try_divide(F.col("c") - F.col("vwap"), F.col("vwap")))
                                             .otherwise(F.lit(0.0)), 6)))


def window_vwap_at(decisions: DataFrame, bars: DataFrame, keys: Sequence[str] = ("asset",), *, at: str = "ts", start: str = "start_ts",
                   ts: str = "ts", width_s: float = DAY_S, block: int = 65_536) -> DataFrame:
    """``decisions`` with vwap and vwap_dev as of time ``at``: over the bars since ``start``, or over the last three bars
    where none has opened since; nulls before the first bar.

    The bars since a round's start are a difference of two running sums, so two as-of joins replace a range join."""
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3.0
    b = bars.select(*keys, F.col(ts).alias("_bt"), "c", (typical * F.col("v")).alias("_tv"), F.col("v").alias("_v"))
    b = running(add_chunk(b, "_bt", width_s), keys, ["_bt"], {"_ctv": ("sum", F.col("_tv")), "_cv": ("sum", F.col("_v"))}).drop(CHUNK)
    b = lookback(b, keys, ["_bt"], 2, ts="_bt", width_s=width_s, block=block)
    w = block_window(keys).rowsBetween(-2, 0)
    b = own_rows(b.withColumns({"_tv3": F.sum("_tv").over(w), "_v3": F.sum("_v").over(w)}))
    now = asof_backward(decisions, b, list(keys), left_ts=at, right_ts="_bt", width_s=width_s,
                        take={"_t1": "_ctv", "_v1": "_cv", "_t3": "_tv3", "_v3": "_v3", "_c": "c", "_last": "_bt"})
    both = asof_backward(now, b, list(keys), left_ts=start, right_ts="_bt", take={"_t0": "_ctv", "_v0": "_cv"}, width_s=width_s, strict=True)
    since = F.col("_last") >= F.col(start)
    tv = F.when(since, F.col("_t1") - F.coalesce("_t0", F.lit(0.0))).otherwise(F.col("_t3"))
    v = F.when(since, F.col("_v1") - F.coalesce("_v0", F.lit(0.0))).otherwise(F.col("_v3"))
    vwap = F.when(v > 0, F.try_divide(tv, v)).otherwise(F.col("_c"))
    out = both.withColumn("vwap", vwap).withColumn("vwap_dev", F.when(F.col("vwap") > 0, F.try_divide(F.col("_c") - F.col("vwap"), F.col("vwap"))).when(F.col("vwap").isNotNull(), F.lit(0.0)))
    return out.select(*decisions.columns, "vwap", "vwap_dev")


def ls_crowding(ratio: Column, side_up: Column, long_ext: float = 1.8, short_ext: float = 0.6) -> Column:
    """-1 where the crowd already sits on the side (limits are ours)."""
    return (F.when(side_up & (ratio > long_ext), F.lit(-1)).when(~side_up & (ratio < short_ext), F.lit(-1))
            .otherwise(F.lit(0)))


def jump_z(ticks: DataFrame, *, recent_s: float = 10, base_s: float = 60, threshold: float = 3.5,
           keys: Sequence[str] = ("asset",), ts: str = "ts", price: str = "price", width_s: float = DAY_S) -> DataFrame:
    """Recent move over the RMS tick move of the preceding window; flags |z| above the threshold.

    Counts and sums over both windows are differences of running sums: a row counts when it comes, when it leaves the recent
    window and when it leaves the base window, so a row costs the same however many a window holds. How many rows have left is also
    the place of a window's first row, which one join by place brings. A row without a time has 0.
    """
    back, rec = int(base_s * 1e6), int(recent_s * 1e6)
    d = with_part(time_halo(ticks, ts, width_s, base_s).withColumn("_t", epoch_us(ts)), [*keys, CHUNK])
    w = Window.partitionBy(PART).orderBy("_t")
    prev = F.lag(price).over(w)
    d = d.withColumns({"_m2": F.pow(div_or(price, F.when(prev > 0, prev), None) - 1.0, F.lit(2.0)), "_pos": F.row_number().over(w)})
    event = lambda off, kind: F.struct((F.col("_t") + off).alias("t"), F.lit(kind).alias("kind"))
    first = d.select(PART, "_pos", F.col(price).alias("_p"), F.col("_m2").alias("_m"))
    e = d.withColumn("_e", F.explode(F.when(F.col("_t").isNull(), F.array(event(0, 0))).otherwise(F.array(event(0, 0), event(rec + 1, 1), event(back + 1, 2)))))
    ew = Window.partitionBy(PART).orderBy("_e.t").rangeBetween(Window.unboundedPreceding, 0)
    so_far = lambda kind, v: F.coalesce(F.sum(F.when(F.col("_e.kind") == kind, v)).over(ew), F.lit(0))
    one, known, moved = F.lit(1), F.col(price).isNotNull().cast("int"), F.coalesce((F.col("_m2") > 0).cast("int"), F.lit(0))
    e = e.withColumns({"_left1": so_far(1, one), "_left2": so_far(2, one), "_rec": so_far(0, known) - so_far(1, known), "_base": so_far(1, known) - so_far(2, known),
                       "_sum": so_far(1, F.col("_m2")) - so_far(2, F.col("_m2")), "_moved": so_far(1, moved) - so_far(2, moved)})
    d = e.where((F.col("_e.kind") == 0) & F.col(OWN)).drop("_m2", "_pos")
    d = d.join(first.select(PART, (F.col("_pos") - 1).cast("long").alias("_left1"), F.col("_p").alias("_p0")), [PART, "_left1"], "left")
    d = d.join(first.select(PART, (F.col("_pos") - 1).cast("long").alias("_left2"), F.col("_m").alias("_m0")), [PART, "_left2"], "left")
    # The first base tick's own move starts outside the base window; where no other move is left, the rest is rounding noise.
    own = F.when(F.col("_base") > 0, F.coalesce("_m0", F.lit(0.0))).otherwise(0.0)
    inner = F.when(F.col("_moved") - (own > 0).cast("int") > 0, F.col("_sum") - own).otherwise(0.0)
    sigma = F.sqrt(F.greatest(inner, F.lit(0.0)) / (F.col("_base") - 1))
    ok, p0 = (F.col("_rec") >= 2) & (F.col("_base") >= 5), F.col("_p0")
    z = F.when(ok & (sigma > 0) & (p0 > 0), F.try_divide((F.col(price) - p0) / p0, sigma)).otherwise(F.lit(0.0))
    out = d.select(*ticks.columns, z.alias("jump_z"))
    return out.withColumn("jump_dir", F.when(F.col("jump_z") > threshold, "Up").when(F.col("jump_z") < -threshold, "Down"))


def lead_signal(ticks: DataFrame, leader: str, vol: float, *, far_s: float = 60, near_s: float = 30, slack_s: float = 5,
                corr: float = 0.75, width_s: float = DAY_S) -> DataFrame:
    """P(Up) of every other asset from the leader's lagged move; 0.5 without both leader ticks.

    Two tolerance as-of joins without an equality key: rows are spread by time chunk.
    """
    lead = ticks.where(F.col("asset") == leader).select("ts", "price")
    at = lambda off: F.timestamp_micros(epoch_us("ts") - int((off - slack_s) * 1e6))
    d = ticks.where(F.col("asset") != leader).withColumn("_far", at(far_s)).withColumn("_near", at(near_s))
    d = asof_backward(d, lead, [], left_ts="_far", right_ts="ts", take={"_pf": "price"}, width_s=width_s,
                      tolerance_s=2 * slack_s)
    d = asof_backward(d, lead, [], left_ts="_near", right_ts="ts", take={"_pn": "price"}, width_s=width_s,
                      tolerance_s=2 * slack_s)
    move = (F.col("_pn") - F.col("_pf")) / F.col("_pf")
    z = move / (vol * math.sqrt(near_s / (252 * 24 * 3600))) * corr
    return (d.withColumn("lead_p", F.when(z.isNotNull(), norm_cdf(z)).otherwise(F.lit(0.5)))
            .drop("_far", "_near", "_pf", "_pn"))


def price_velocity(ticks: DataFrame, *, min_age_s: float = 60, keys: Sequence[str] = ("asset",), ts: str = "ts",
                   price: str = "price", width_s: float = DAY_S) -> DataFrame:
    """Price now minus the newest one at least ``min_age_s`` old, however many came since; 0 without one."""
    d = ticks.withColumn("_then", F.timestamp_micros(epoch_us(ts) - int(min_age_s * 1e6)))
    old = ticks.select(*keys, F.col(ts).alias("_ts"), F.col(price).alias("_p"))
    d = asof_backward(d, old, list(keys), left_ts="_then", right_ts="_ts", take={"_old": "_p"}, width_s=width_s)
    return d.withColumn("velocity", F.coalesce(F.col(price) - F.col("_old"), F.lit(0.0))).drop("_old", "_then")


def prev_round_direction(rounds: DataFrame, *, keys: Sequence[str] = ("asset", "duration"), ts: str = "start_ts",
                         dead_band: float = 0.0002, width_s: float | None = None, block: int = 65_536) -> DataFrame:
    """Direction of each round's open against the previous one, with a dead band."""
    d = lookback(rounds, keys, [ts], 1, ts=ts, width_s=width_s, block=block)
    prev = F.lag("open").over(block_window(keys))
    move = div_or(F.col("open") - prev, F.when((prev > 0) & (F.col("open") > 0), prev), None)
    d = d.withColumn("prev_move", F.coalesce(F.abs(move), F.lit(0.0))).withColumn(
        "prev_dir", F.when(move > dead_band, "Up").when(move < -dead_band, "Down"))
    return own_rows(d)


def trailing_sums(rows: DataFrame, window_s: float, values: dict[str, Column], *, keys: Sequence[str], ts: str, width_s: float) -> DataFrame:
    """Adds, per name, the sum of a column (double; null: nothing) over the rows of the last ``window_s`` seconds, rows of the same time
    included, and exactly 0.0 where no row holds a value.

    Every row counts when it comes and is taken back when it leaves the window, so one running sum over both kinds of events
    gives all windows: the cost of a row does not grow with the rows in a window. Rows without a time form one window."""
    d = time_halo(rows, ts, width_s, window_s).withColumns({"_t": epoch_us(ts), **{f"_v_{n}": v.cast("double") for n, v in values.items()}})
    event = lambda t, sign: F.struct(t.alias("t"), F.lit(sign).alias("sign"))
    comes, leaves = event(F.col("_t"), 1), event(F.col("_t") + int(window_s * 1e6) + 1, -1)
    d = d.withColumn("_e", F.explode(F.when(F.col("_t").isNull(), F.array(comes)).otherwise(F.array(comes, leaves))))
    d = d.withColumns({"_at": F.col("_e.t"), "_sg": F.col("_e.sign")})
    w = Window.partitionBy(*keys, CHUNK).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    for n in values:
        held = F.sum(F.when(F.col(f"_v_{n}").isNotNull(), F.col("_sg"))).over(w)
        # what is left of rows that were taken back is rounding noise
        d = d.withColumn(n, F.when(held > 0, F.round(F.sum(F.col(f"_v_{n}") * F.col("_sg")).over(w), 9)).otherwise(F.lit(0.0)))
    return d.where((F.col("_sg") > 0) & F.col(OWN)).drop("_t", "_e", "_at", "_sg", CHUNK, OWN, *[f"_v_{n}" for n in values])


def agg_ofi(trades: DataFrame, *, window_s: float = 30, keys: Sequence[str] = ("asset",), ts: str = "ts",
            width_s: float = DAY_S) -> DataFrame:
    """Signed share of taker volume over a trailing window (+1 all buys, -1 all sells)."""
    signed = F.when(F.upper("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    d = trailing_sums(trades, window_s, {"_signed": signed, "_size": F.col("size")}, keys=keys, ts=ts, width_s=width_s)
    return d.withColumn("ofi", div_or("_signed", "_size", 0.0)).drop("_signed", "_size")


def liquidation_signal(liqs: DataFrame, *, window_s: float = 60, strong: float = 3.0, keys: Sequence[str] = ("asset",),
                       ts: str = "ts", width_s: float = DAY_S) -> DataFrame:
    """0 / 1 / 2 points for Up and for Down: liquidations of the other side confirm a direction.

    A liquidated short is a forced BUY and supports Up. One point when its value exceeds the
    other side's, two when it is ``strong`` times as large (limits are ours).
    """
    sides = {"_buys": F.when(F.upper("side") == "BUY", F.col("size")), "_sells": F.when(F.upper("side") != "BUY", F.col("size"))}
    d = trailing_sums(liqs, window_s, sides, keys=keys, ts=ts, width_s=width_s)
    pts = lambda a, b: F.when((F.col(a) > 0) & (F.col(a) >= F.col(b) * strong), 2).when(F.col(a) > F.col(b), 1).otherwise(0)
    return d.withColumn("liq_up", pts("_buys", "_sells")).withColumn("liq_down", pts("_sells", "_buys")).drop("_buys", "_sells")
