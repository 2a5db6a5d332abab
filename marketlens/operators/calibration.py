"""Probability calibration: history features, reliability curve, Platt fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import clamp
from ..functions.prob import logistic, logit
from .asof import asof_backward
from .features import BarFrame
from .ordered import checkpointed

# Correlation of each asset with the leader.
LEADER_CORR = {"ETH": 0.82, "SOL": 0.80, "XRP": 0.78}
LEADER_CORR_OTHER = 0.77
LEADER_MINUTES = 30


def hist_calibration(rounds: DataFrame, bars: DataFrame, *, leader: str = "BTC", width_s: float = 30 * 86_400, block: int = 65_536,
                     bar_s: float = 300.0, strict: bool = False) -> DataFrame:
    """(asset, round_ts, side, won, llr, true_prob) for every round side with enough history.

    Bars are matched by *open* time at or before the round start, although a bar's close is only
    known ``bar_s`` later; ``strict`` uses the close time instead. Features are computed once per bar
    over its last 14 closes and carried to rounds by as-of joins. Features and rounds are used several times, so both are
    written to the checkpoint folder once instead of being derived anew for every use.
    """
    rounds = checkpointed(rounds)
    f = BarFrame(bars.select("asset", "ts", "c"), n=14, block=block)
    feats = f.with_features(_n=f.bars_seen(14), _k=F.count("_ret").over(f.rows(12)), _sigma=f.rms_sigma(14), _ret12=f.displacement(12))
    if strict:
        feats = feats.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + int(bar_s * 1e6)))
    feats = checkpointed(feats)
    take = {"_n": "_n", "_k": "_k", "_sigma": "_sigma", "_ret12": "_ret12"}
    d = asof_backward(rounds, feats, ["asset"], left_ts="start_ts", right_ts="ts", take=take, width_s=width_s)
    d = d.where((F.col("_n") >= 5) & (F.col("_k") >= 3) & F.col("_ret12").isNotNull())
    lead = feats.where(F.col("asset") == leader)
    # The leader is looked up by time only: once per distinct instant, for starts and for half an hour before.
    back = F.timestamp_micros(F.unix_micros(F.col("start_ts").cast("timestamp")) - LEADER_MINUTES * 60_000_000)
    d = d.withColumns({"_at": F.col("start_ts").cast("timestamp"), "_back": back})
    when = rounds.select(F.explode(F.array(F.col("start_ts").cast("timestamp"), back)).alias("_at")).distinct()
    seen = asof_backward(when, lead, [], left_ts="_at", right_ts="ts", take={"_ln": "_n", "_lk": "_k", "_ls": "_sigma", "_lc": "c"}, width_s=width_s)
    d = d.join(seen, "_at").join(seen.select(F.col("_at").alias("_back"), F.col("_lc").alias("_l0")), "_back")
    root3 = math.sqrt(3.0)
    corr = F.lit(LEADER_CORR_OTHER)
    for a, v in LEADER_CORR.items():
        corr = F.when(F.col("asset") == a, F.lit(v)).otherwise(corr)
    use = (F.col("asset") != leader) & (F.col("_ln") >= 5) & (F.col("_lk") >= 1) & (F.col("_l0") > 0)
    lead_term = F.when(use, (F.col("_lc") - F.col("_l0")) / F.col("_l0") / (F.col("_ls") * root3) * corr * 0.8).otherwise(F.lit(0.0))
    llr = F.col("_ret12") / (F.col("_sigma") * root3) * 0.8 + lead_term
    p = F.when(F.col("side") == "Up", logistic(F.col("_llr"))).otherwise(1.0 - logistic(F.col("_llr")))
    return (d.withColumn("_llr", llr).withColumn("side", F.explode(F.array(F.lit("Up"), F.lit("Down"))))
            .select("asset", (F.unix_micros(F.col("start_ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("round_ts"), "side",
                    (F.col("side") == F.col("winner")).cast("bigint").alias("won"), F.round("_llr", 6).alias("llr"),
                    F.round(clamp(p, 0.05, 0.95), 6).alias("true_prob")))


def new_rows(rows: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("asset", "round_ts", "side")) -> DataFrame:
    """Insert-or-ignore: rows whose key is not stored yet, one per key."""
    return rows.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def calibration_curve(hist: DataFrame, bins: int = 18, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Reliability bins: count, mean forecast, win rate and squared error per probability bin."""
    b = F.least(F.lit(bins), F.width_bucket("true_prob", F.lit(lo), F.lit(hi), F.lit(bins)))
    return hist.groupBy(b.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_prob").alias("mean_prob"), F.avg("won").alias("win_rate"),
        F.avg(F.pow(F.col("true_prob") - F.col("won"), F.lit(2.0))).alias("brier"))


def platt_fit(hist: DataFrame, *, steps: int = 20, tol: float = 1e-10) -> DataFrame:
    """One row (a, b): P = logistic(a * logit(p) + b) fitted by maximum likelihood, by Newton steps from (1, 0).

    Probabilities carry 6 decimals, so the data is first counted per (p, outcome), at most 2 x 900,001 cells; each step
    sums five numbers over the cells. Rows with a null are left out. Without a unique fit (no rows, one p) a step that
    cannot be solved ends the fit.
    """
    cells = checkpointed(hist.where(F.col("true_prob").isNotNull() & F.col("won").isNotNull()).groupBy("true_prob", "won")
                         .agg(F.count(F.lit(1)).cast("double").alias("n")).select(logit("true_prob").alias("x"), F.col("won").cast("double").alias("y"), "n"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = logistic(F.lit(a) * F.col("x") + F.lit(b))
        miss, w = F.col("n") * (F.col("y") - q), F.col("n") * q * (1.0 - q)
        ga, gb, haa, hab, hbb = (v or 0.0 for v in cells.agg(F.sum(miss * F.col("x")), F.sum(miss), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first())
        det = haa * hbb - hab * hab
        if det <= 1e-12 * max(1.0, haa * hbb):
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tol:
            break
    return hist.sparkSession.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))
