"""Trade results: summaries, breakdowns, drawdowns, streaks, rolling quality, quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import ColumnOrName, c, clamp, div_or, epoch_s, profit_factor, round_to, safe_double, sum_if
from ..functions.normalize import age_bucket, score_bucket
from ..functions.prob import direction_bias, drawdown_scale, fee_stake, wilson_lb
from .asof import asof_forward
from .ordered import CHUNK, PART, add_chunk, balanced_chunks, block_window, lookback, own_rows, part_keys, running, with_part, written

MONTH_S = 30 * 86_400
_PRIOR = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)

# ENTRY fields that complete a RESOLVE row.
ENTRY_FIELDS = ("score", "cl_agree", "open_price_source", "chainlink_age_s", "onchain_score_adj")


# ---------------------------------------------------------------- joins and settlement
def entry_resolve_join(entries: DataFrame, resolves: DataFrame, order: Sequence[str], fields: Sequence[str] = ENTRY_FIELDS,
                       *, present: str | None = None) -> DataFrame:
    """Every RESOLVE with the last ENTRY of its market filling absent fields.

    ``present`` names an array column of the keys the raw RESOLVE line held: a key that is there but
    null stays null. Without it null counts as absent. The last ENTRY is found by a map-side
    combinable ``max_by`` before the join.
    """
    have = [f for f in fields if f in entries.columns]
    last = entries.groupBy("condition_id").agg(
        F.max_by(F.struct(*have), F.struct(*order)).alias("_e"))
    out = resolves.join(last, "condition_id", "left")
    for f in have:
        if f not in resolves.columns:
            out = out.withColumn(f, F.col(f"_e.{f}"))
        elif present is not None:
            out = out.withColumn(f, F.when(F.array_contains(present, f), F.col(f)).otherwise(F.col(f"_e.{f}")))
        else:
            out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"_e.{f}")))
    return out.drop("_e")


def settle_pnl(won: ColumnOrName, size: ColumnOrName, entry: ColumnOrName, mkt_price: ColumnOrName,
               redeem_in: ColumnOrName | None = None, stake_out: ColumnOrName | None = None) -> Column:
    """Profit of a settled position: money received less stake, or minus the stake.

    Without a positive redeem amount the payout is size / entry less the fee.
    """
    stake = c(size) if stake_out is None else F.greatest(c(size), F.coalesce(c(stake_out), F.lit(0.0)))
    payout = c(size) / F.greatest(c(entry), F.lit(1e-9)) - fee_stake(size, mkt_price)
    got = payout if redeem_in is None else F.when(F.coalesce(c(redeem_in), F.lit(0.0)) > 0, c(redeem_in)).otherwise(payout)
    return F.when(c(won), got - stake).otherwise(-stake)


# ---------------------------------------------------------------- summaries
def _ratio(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0.0, F.lit(0.0)).otherwise(F.try_divide(mean, sd) * F.sqrt(n))


def _join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Joins two tables of one row per group; a null group key matches itself."""
    return with_part(a, by).join(with_part(b, by).drop(*by), PART).drop(PART)


def pnl_summary(rows: DataFrame, by: Sequence[str], order: Sequence[str], *, pnl: str = "pnl", bank_after: str | None = None,
                unit: float = 1000.0, ts: str = "ts", width_s: float | None = None) -> DataFrame:
    """Trades, win rate, totals, Sharpe, Sortino (99 without losses), maximum drawdown per group.

    A return is pnl over the bank before it; without a bank column, pnl / ``unit``. Sharpe and Sortino
    scale with the square root of the number of returns.
    """
    p = safe_double(pnl)
    if bank_after is None:
        r = p / unit
    else:
        b = safe_double(bank_after)
        r = F.when(b > 0, p / F.greatest(F.lit(1e-9), b - p))
    x = rows.withColumn("_p", p).withColumn("_r", r)
    down = F.when(F.col("_r") < 0, F.col("_r"))
    agg = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("result") == "WIN").alias("wins"),
        F.sum("_p").alias("total_pnl"), F.avg("_p").alias("avg_pnl"), F.avg("_r").alias("_m"),
        F.stddev_samp("_r").alias("_sd"), F.count("_r").alias("_n"), F.count(down).alias("_nd"), F.stddev_samp(down).alias("_sdd"))
    agg = agg.withColumns({
        "win_rate": F.col("wins") / F.col("trades"), "sharpe": _ratio(F.col("_m"), F.col("_sd"), F.col("_n")),
        "sortino": F.when(F.col("_nd") == 0, F.lit(99.0)).otherwise(_ratio(F.col("_m"), F.col("_sdd"), F.col("_n")))})
    dd = max_drawdown(x, by, order, pnl="_p", ts=ts, width_s=width_s)
    return _join_groups(agg.drop("_m", "_sd", "_n", "_nd", "_sdd"), dd, list(by))


def pnl_breakdown(rows: DataFrame) -> DataFrame:
    """n, win rate and pnl by open-price source, oracle age and score bucket, in one scan."""
    x = rows.select(F.coalesce("open_price_source", F.lit("missing")).alias("src"), age_bucket("chainlink_age_s").alias("age"),
                    score_bucket("score").alias("score"), (F.col("result") == "WIN").alias("win"), safe_double("pnl").alias("pnl"))
    # One aggregation over the (source, age, score) cells, then three tiny roll-ups.
    cells = x.groupBy("src", "age", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"), F.sum("pnl").alias("pnl"))
    g = cells.groupingSets([["src"], ["age"], ["score"]], "src", "age", "score").agg(
        F.grouping("src").alias("_gs"), F.grouping("age").alias("_ga"),
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("pnl").alias("pnl"))
    kind = F.when(F.col("_gs") == 0, "source").when(F.col("_ga") == 0, "age").otherwise("score")
    return g.select(kind.alias("dimension"), F.coalesce("src", "age", "score").alias("bucket"), "n", "wins",
                    (F.col("wins") / F.col("n")).alias("win_rate"), "pnl")


def bucket_stats(outcomes: DataFrame, by: Sequence[str] = ("bucket",), *, fills: DataFrame | None = None) -> DataFrame:
    """Outcome and fill statistics per bucket; ``fills`` has (by, slip_bps)."""
    p = F.col("pnl")
    o = outcomes.groupBy(*by).agg(
        F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.count(F.lit(1)).alias("outcomes"),
        F.sum(p).alias("pnl"), sum_if(F.col("won"), F.greatest(F.lit(0.0), p)).alias("gross_win"),
        sum_if(~F.col("won"), F.greatest(F.lit(0.0), -p)).alias("gross_loss"))
    if fills is None:
        return o.withColumn("n", F.col("outcomes"))
    f = fills.groupBy(*by).agg(F.count(F.lit(1)).alias("fills"), F.sum("slip_bps").alias("slip_bps"))
    zero = {x: 0 for x in ("wins", "losses", "outcomes", "fills")} | {x: 0.0 for x in ("pnl", "gross_win", "gross_loss", "slip_bps")}
    return o.join(f, list(by), "full_outer").fillna(zero).withColumn("n", F.col("outcomes") + F.col("fills"))


def growth_snapshot(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profit factor, expectancy and average slip over all buckets (of each ``by`` group)."""
    g = stats.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("outcomes", "gross_win", "gross_loss", "pnl", "fills", "slip_bps")])
    return g.select(*by, "outcomes", "gross_win", "gross_loss", profit_factor("gross_win", "gross_loss").alias("pf"),
                    (F.col("pnl") / F.greatest(F.lit(1), F.col("outcomes"))).alias("expectancy"),
                    (F.col("slip_bps") / F.greatest(F.lit(1), F.col("fills"))).alias("avg_slip"))


def top_bucket(stats: DataFrame) -> DataFrame:
    """The bucket with most rows, with its rates."""
    v = F.max_by(F.struct(*stats.columns), F.struct("n", F.col("bucket"))).alias("r")
    r = stats.agg(v).select("r.*")
    return r.select("bucket", "fills", "outcomes", div_or(F.col("wins") * 100.0, "outcomes", 0.0).alias("wr"),
                    profit_factor("gross_win", "gross_loss").alias("pf"),
                    (F.col("pnl") / F.greatest(F.lit(1), F.col("outcomes"))).alias("exp"), div_or("slip_bps", "fills", 0.0).alias("slip"))


def side_perf(results: DataFrame) -> DataFrame:
    """Per asset and side: n, gross win / loss, pnl and the resulting probability bias."""
    p = F.col("pnl")
    g = results.groupBy("asset", "side").agg(
        F.count(F.lit(1)).alias("n"), sum_if(p >= 0, p).alias("gross_win"), sum_if(p < 0, -p).alias("gross_loss"), F.sum(p).alias("pnl"))
    return g.withColumn("bias", direction_bias("n", "gross_win", "gross_loss", "pnl"))


def asset_quality(perf: DataFrame, *, min_trades: int = 10, block_pf: float = 0.7, block_exp: float = -0.5, min_pf: float = 1.0,
                  min_exp: float = 0.0, penalty: int = 2, edge_penalty: float = 0.010) -> DataFrame:
    """Score and edge penalties from ``side_perf``; limits are parameters."""
    pf = profit_factor("gross_win", "gross_loss")
    exp = F.col("pnl") / F.greatest(F.lit(1), F.col("n"))
    mature = F.col("n") >= min_trades
    block = mature & (pf <= block_pf) & (exp <= block_exp)
    weak = mature & ((pf < min_pf) | (exp < min_exp))
    return perf.withColumns({
        "pf": pf, "expectancy": exp, "blocked": block,
        "score_adj": -(F.when(block, max(3, penalty + 1)).otherwise(0) + F.when(weak, penalty).otherwise(0)),
        "edge_adj": -(F.when(block, max(0.015, edge_penalty + 0.005)).otherwise(0.0) + F.when(weak, edge_penalty).otherwise(0.0))})


def sample_prior(samples: DataFrame, keys: Sequence[str], order: Sequence[str], *, keep: int | None = None) -> DataFrame:
    """Win rate, Wilson bound and expectancy of all outcomes per key, or of the newest ``keep`` where a window is wanted.

    With ``keep``, a row number limit of up to 1,000 is applied per map task before the shuffle.
    """
    newest = samples
    if keep is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in order])
        newest = samples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    g = newest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("wins"), F.sum("pnl").alias("_p"),
                                  sum_if(F.col("pnl") > 0, "pnl").alias("_gw"), sum_if(F.col("pnl") < 0, -F.col("pnl")).alias("_gl"))
    return g.select(*keys, "n", "wins", (F.col("wins") / F.col("n")).alias("wr"), wilson_lb("wins", "n").alias("wr_lb"),
                    (F.col("_p") / F.col("n")).alias("expectancy"), profit_factor("_gw", "_gl").alias("pf"))


def profile_adjustments(profile: DataFrame, *, min_n: int = 12, good_lb: float = 0.54, bad_lb: float = 0.44,
                        max_prob: float = 0.03) -> DataFrame:
    """Small probability / edge / score changes from a ``sample_prior`` table (rule is ours)."""
    ok = F.col("n") >= min_n
    tilt = clamp((F.col("wr_lb") - 0.5) * 0.5, -max_prob, max_prob)
    good = ok & (F.col("wr_lb") >= good_lb) & (F.col("expectancy") > 0)
    bad = ok & (F.col("wr_lb") <= bad_lb) & (F.col("expectancy") < 0)
    return profile.withColumns({
        "prob_adj": F.when(ok, tilt).otherwise(F.lit(0.0)), "edge_adj": F.when(ok, tilt * 0.5).otherwise(F.lit(0.0)),
        "score_adj": F.when(good, 1).when(bad, -1).otherwise(0)})


def profile_results(ledger: DataFrame, order: Sequence[str], *, bankroll: float = 100.0, ts: str = "ts",
                    width_s: float | None = None) -> DataFrame:
    """Trades, wins, win rate, pnl and drawdown of every run."""
    x = ledger.where(F.upper("result").isin("WIN", "LOSS")).withColumn("_p", safe_double("pnl"))
    g = x.groupBy("profile").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.upper("result") == "WIN").alias("wins"), F.sum("_p").alias("_s"))
    dd = max_drawdown(x, ["profile"], order, pnl="_p", start=bankroll, ts=ts, width_s=width_s)
    return _join_groups(g, dd, ["profile"]).select(
        "profile", "trades", "wins", round_to(F.col("wins") / F.col("trades") * 100, 2).alias("wr"),
        round_to("_s", 2).alias("pnl"), round_to("max_dd", 2).alias("max_dd"))


def rank_profiles(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("pnl"), F.desc("wr"), F.asc("max_dd"), F.asc("profile"))


def roi_report(results: DataFrame, by: Sequence[str], start_bank: float) -> DataFrame:
    """Return on the starting bank, expectancy per trade and win rate per period."""
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.count_if("won").alias("wins"), F.sum("pnl").alias("pnl"))
    return g.withColumns({"roi_pct": F.col("pnl") / start_bank * 100.0, "avg_ev": F.col("pnl") / F.col("trades"),
                          "win_rate": F.col("wins") / F.col("trades") * 100.0})


def fill_quality(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    return fills.groupBy(*by).agg(F.count(F.lit(1)).alias("fills"), F.sum("slip_bps").alias("slip_sum"), F.avg("slip_bps").alias("avg_slip"))


def skip_funnel(gated: DataFrame, reason: str = "reason") -> DataFrame:
    return gated.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- equity, drawdown, streaks
def _chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, width_s: float | None) -> DataFrame:
    """Rows with their chunk and its key struct; without a width, chunks of equal row counts."""
    d = balanced_chunks(rows, keys, order) if width_s is None else add_chunk(rows, ts, width_s)
    return with_part(d, [*keys, CHUNK])


def equity_curve(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, pnl: str = "pnl", start: float = 0.0,
                 ts: str = "ts", width_s: float | None = None) -> DataFrame:
    """Adds equity, peak and drawdown after each row, and equity / peak before it.

    Windows run inside (key, time chunk); a chunk hands its total and its highest point to the next
    ones through one row. The rows move once.
    """
    keys = list(keys)
    w = Window.partitionBy(PART).orderBy(*order)
    d = _chunked(rows, keys, order, ts, width_s).withColumn("_eq", F.sum(pnl).over(w.rowsBetween(*_SO_FAR)))
    d = d.withColumns({"_pk": F.max("_eq").over(w.rowsBetween(*_SO_FAR)), "_pk0": F.max("_eq").over(w.rowsBetween(*_PRIOR))})
    cw = Window.partitionBy(*part_keys(keys)).orderBy(F.col(f"{PART}.{CHUNK}")).rowsBetween(*_PRIOR)
    carry = (d.groupBy(PART).agg(F.sum(pnl).alias("_tot"), F.max("_eq").alias("_mx"))
             .withColumn("_e0", F.coalesce(F.sum("_tot").over(cw), F.lit(0.0)) + start)
             .withColumn("_p0", F.greatest(F.lit(start), F.max(F.col("_e0") + F.col("_mx")).over(cw)))
             .select(PART, "_e0", "_p0"))
    out = d.join(carry, PART)
    equity, peak = F.col("_e0") + F.col("_eq"), F.greatest("_p0", F.col("_e0") + F.col("_pk"))
    return out.select(*[F.col(x) for x in rows.columns], equity.alias("equity"), peak.alias("peak"), (peak - equity).alias("drawdown"),
                      (equity - F.col(pnl)).alias("equity_before"), F.greatest("_p0", F.col("_e0") + F.col("_pk0")).alias("peak_before"))


def max_drawdown(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, pnl: str = "pnl", start: float = 0.0,
                 ts: str = "ts", width_s: float | None = None) -> DataFrame:
    """Largest fall from a running peak per key.

    Each chunk keeps four numbers (total, highest and lowest point, own drawdown); the chunks of a
    key are then combined, so no row is joined back.
    """
    keys = list(keys)
    part = [*keys, CHUNK]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*_SO_FAR)
    d = (balanced_chunks(rows, keys, order) if width_s is None else add_chunk(rows, ts, width_s)).withColumn("_eq", F.sum(pnl).over(w))
    d = d.withColumn("_dd", F.greatest(F.max("_eq").over(w), F.lit(0.0)) - F.col("_eq"))
    cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*_PRIOR)
    chunks = (d.groupBy(*part).agg(F.sum(pnl).alias("_tot"), F.max("_eq").alias("_mx"), F.min("_eq").alias("_mn"), F.max("_dd").alias("_in"))
              .withColumn("_e0", F.coalesce(F.sum("_tot").over(cw), F.lit(0.0)) + start)
              .withColumn("_p0", F.greatest(F.lit(start), F.max(F.col("_e0") + F.col("_mx")).over(cw))))
    return chunks.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.max(F.greatest("_in", F.col("_p0") - (F.col("_e0") + F.col("_mn"))))).alias("max_dd"))


def drawdown_scales(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, start: float, pnl: str = "pnl", ts: str = "ts",
                    width_s: float | None = None) -> DataFrame:
    """Stake multiplier before each trade from the relative drawdown at that time."""
    e = equity_curve(rows, keys, order, pnl=pnl, start=start, ts=ts, width_s=width_s)
    dd = F.when(F.col("peak_before") > 0, F.try_divide(F.col("peak_before") - F.col("equity_before"), F.col("peak_before")))
    return e.withColumn("dd_scale", F.coalesce(drawdown_scale(dd), F.lit(1.0)))


def loss_streak_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, won: str = "won", ts: str = "ts",
                     width_s: float | None = None) -> DataFrame:
    """Adds ``streak``: consecutive losses up to and including each row (0 after a win).

    The position of the last win is a running maximum, so chunks only hand over (rows, last win).
    """
    keys = list(keys)
    w = Window.partitionBy(PART).orderBy(*order)
    d = _chunked(rows, keys, order, ts, width_s).withColumn("_rn", F.row_number().over(w))
    d = d.withColumn("_win", F.max(F.when(F.col(won), F.col("_rn"))).over(w.rowsBetween(*_SO_FAR)))
    cw = Window.partitionBy(*part_keys(keys)).orderBy(F.col(f"{PART}.{CHUNK}")).rowsBetween(*_PRIOR)
    carry = (d.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"), F.max("_win").alias("_lw"))
             .withColumn("_n0", F.coalesce(F.sum("_n").over(cw), F.lit(0)))
             .withColumn("_w0", F.coalesce(F.max(F.col("_n0") + F.col("_lw")).over(cw), F.lit(0)))
             .select(PART, "_n0", "_w0"))
    pos = F.col("_n0") + F.col("_rn")
    return d.join(carry, PART).select(*[F.col(x) for x in rows.columns], pos.alias("seq"),
                                      (pos - F.coalesce(F.col("_n0") + F.col("_win"), F.col("_w0"))).alias("streak"))


def loss_streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """Longest and current losing streak per key."""
    s = loss_streak_rows(rows, keys, order, **kw)
    return s.groupBy(*keys).agg(F.max("streak").alias("max_streak"), F.max_by("streak", "seq").alias("current_streak"))


def booster_lock(addons: DataFrame, candidates: DataFrame, keys: Sequence[str], order: Sequence[str], *, k: int = 3,
                 lock_hours: float = 6.0, ts: str = "ts", at: str = "ts", width_s: float | None = None) -> DataFrame:
    """Candidates with ``locked``: k straight add-on losses lock for some hours, a win resets.

    Only the newest add-on before a candidate matters, so this is a streak plus an as-of join.
    """
    from .asof import asof_backward
    s = loss_streak_rows(addons, keys, order, ts=ts, width_s=width_s).select(*keys, ts, "streak", "seq")
    out = asof_backward(candidates, s, keys, left_ts=at, right_ts=ts, take={"_streak": "streak", "_last": ts}, width_s=width_s,
                        right_tie=("seq",))
    until = F.col("_last").cast("timestamp") + F.make_dt_interval(hours=F.lit(int(lock_hours)), secs=F.lit((lock_hours % 1) * 3600))
    return out.withColumn("locked", F.coalesce((F.col("_streak") >= k) & (F.col(at) < until), F.lit(False))).drop("_streak", "_last")


# ---------------------------------------------------------------- rolling quality before each trade
class PriorFrame:
    """Results with every frame of up to ``n`` earlier rows available (the row itself is left out)."""

    def __init__(self, results: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 20, *, ts: str = "ts",
                 width_s: float | None = None, block: int = 65_536):
        self.df = lookback(results, keys, order, n, ts=ts, width_s=width_s, block=block)
        self.w = block_window(keys)

    def before(self, n: int) -> Window:
        return self.w.rowsBetween(-n, -1)

    def with_columns(self, **cols: Column) -> DataFrame:
        return own_rows(self.df.withColumns(cols))

    def _pf(self, n: int) -> tuple[Column, Column, Column]:
        w, p = self.before(n), F.col("pnl")
        gw = F.coalesce(F.sum(F.when(p > 0, p)).over(w), F.lit(0.0))
        gl = F.coalesce(F.sum(F.when(p < 0, -p)).over(w), F.lit(0.0))
        return F.count("pnl").over(w), profit_factor(gw, gl), F.avg("pnl").over(w)

    def recent_pf(self, n: int = 20) -> Column:
        return self._pf(n)[1]

    def bet_scale(self, n: int = 16, need: int = 8) -> Column:
        k, pf, exp = self._pf(n)
        return (F.when(k < need, F.lit(1.0)).when((pf >= 1.45) & (exp > 0.40), F.lit(1.12))
                .when((pf >= 1.20) & (exp > 0.10), F.lit(1.05)).when((pf < 1.00) | (exp < 0.0), F.lit(0.85)).otherwise(F.lit(1.0)))

    def momentum_weight(self, n: int = 10, need: int = 5, base: float = 0.40) -> Column:
        k, _, exp = self._pf(n)
        return F.when((k >= need) & (exp < 0), F.lit(min(0.65, base + 0.15))).otherwise(F.lit(base))

    def rolling3_score_add(self, penalty: int = 2) -> Column:
        """Extra score wanted while fewer than two of the last three trades won."""
        w = self.before(3)
        return F.when((F.count("won").over(w) >= 3) & (F.count_if(F.col("won")).over(w) < 2), F.lit(penalty)).otherwise(F.lit(0))

    def winning(self, n: int) -> Column:
        return F.count_if(F.col("won")).over(self.before(n))


# ---------------------------------------------------------------- exact quantile
def exclusive_quantile(rows: DataFrame, by: Sequence[str], value: str, *, cut: int = 19, cuts: int = 20,
                       bin_width: float = 100.0) -> DataFrame:
    """Exact exclusive quantile ``cut``/``cuts`` per group with mean and count (n = 1 gives the value).

    Values are counted first (map-side combined), ranked inside value bins, and bins hand over their
    counts; no group is collected.
    """
    by = list(by)
    part = [*by, CHUNK]
    vc = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    vc = vc.withColumn(CHUNK, F.floor(F.col(value) / bin_width))
    local = F.sum("_k").over(Window.partitionBy(*part).orderBy(value).rowsBetween(*_SO_FAR))
    cw = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(*_PRIOR)
    bins = vc.groupBy(*part).agg(F.sum("_k").alias("_b")).withColumn("_before", F.coalesce(F.sum("_b").over(cw), F.lit(0)))
    total = vc.groupBy(*by).agg(F.sum("_k").alias("n"), (F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("mean"))
    ranked = vc.withColumn("_hi", local).join(bins.select(*part, "_before"), part).join(total, by)
    pos = F.floor(F.lit(cut) * (F.col("n") + 1) / F.lit(cuts)).cast("bigint")
    lo = F.greatest(F.lit(1), F.least(pos, F.col("n") - 1))
    delta = F.lit(cut) * (F.col("n") + 1) - lo * cuts
    top = F.col("_before") + F.col("_hi")
    covers = lambda r: (top - F.col("_k") < r) & (top >= r)
    g = ranked.groupBy(*by, "n", "mean").agg(F.max(F.when(covers(lo), F.col(value))).alias("_a"),
                                             F.max(F.when(covers(lo + 1), F.col(value))).alias("_b"))
    q = F.when(F.col("n") == 1, F.col("_a")).otherwise((F.col("_a") * (cuts - delta) + F.col("_b") * delta) / cuts)
    return g.withColumn("q", q).select(*by, "n", "mean", "q")


def latency_summary(probes: DataFrame, by: Sequence[str], value: str = "latency_ms", limit_ms: float = 800.0,
                    bin_width: float = 100.0) -> DataFrame:
    """Mean, p95 and pass / fail per endpoint."""
    q = exclusive_quantile(probes, by, value, bin_width=bin_width)
    return q.withColumnRenamed("q", "p95").withColumn("ok", F.col("p95") <= limit_ms)


# ---------------------------------------------------------------- prediction variants
# The three parallel predictors.
VARIANTS = ("balanced", "momentum", "empirical")


def variant_scores(outcomes: DataFrame, *, by: Sequence[str] = (), probs: str = "variant_probs") -> DataFrame:
    """Per variant: n, wins, pnl, mean squared error, Wilson bound and score.

    ``probs`` is a map variant -> probability. It is exploded into exactly three rows.
    """
    err = F.pow(F.coalesce(F.col(probs)[F.col("variant")], F.lit(0.5)) - F.col("won").cast("double"), F.lit(2.0))
    x = outcomes.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).withColumn("_err", err)
    g = x.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("wins"), F.sum("pnl").alias("pnl"), F.avg("_err").alias("brier"))
    g = g.withColumn("wr_lb", wilson_lb("wins", "n"))
    return g.withColumn("score", F.col("pnl") / F.col("n") * 0.18 + (F.col("wr_lb") - 0.5) * 0.65 - F.col("brier") * 0.10)


def variant_weights(scores: DataFrame, *, by: Sequence[str] = (), min_samples: int = 24,
                    reliability: ColumnOrName | float = 1.0) -> DataFrame:
    """Blend weights with a warm-up penalty; equal while the evidence is thin (three rows per group)."""
    w = Window.partitionBy(*[c(x) for x in by]) if by else Window.partitionBy(F.lit(0))
    raw = F.greatest(F.lit(0.02), c(reliability) * 0.7 + F.col("score") * 2.2 + 0.45 - F.greatest(F.lit(0.0), 8 - F.col("n")) * 0.03)
    d = scores.withColumn("_raw", raw)
    thin = F.sum("n").over(w) < max(6, min_samples // 2)
    return d.withColumn("weight", F.when(thin, F.lit(1.0 / len(VARIANTS))).otherwise(F.col("_raw") / F.sum("_raw").over(w))).drop("_raw")


def variant_switch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, best: str = "best", hold_s: float = 300, start: str | None = None,
                   ts: str = "ts", block: int = 1_000_000) -> DataFrame:
    """Adds ``active``: the variant in use after each row, where ``best`` takes over at most once per ``hold_s`` seconds.

    ``start`` is in use before the first row (None: the first best). ``order`` begins with ``ts``. A run of at most ``block`` rows is
    read in order by one task, which keeps the variant and its switch time; its rows move once. Longer runs are spread over all
    tasks (``_long_switch``). Rows without a time come first and never switch; a null best changes nothing.
    """
    d = with_part(rows, keys, "_key")
    long_runs = written(d.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("_key"))
    if long_runs.isEmpty():
        return _short_switch(d, order, best, hold_s, start, ts)
    few = F.broadcast(long_runs)  # at most rows / block
    short = _short_switch(d.join(few, "_key", "left_anti"), order, best, hold_s, start, ts)
    return short.unionByName(_long_switch(d.join(few, "_key", "left_semi").drop("_key"), keys, order, best, hold_s, start, ts))


def _short_switch(d: DataFrame, order: Sequence[str], best: str, hold_s: float, start: str | None, ts: str) -> DataFrame:
    """``variant_switch`` run by run: sorted partitions stream through Arrow batches, and the variant in use is the only state."""
    run = Window.partitionBy("_key")
    whole = run.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.lit(start) if start is not None else F.first(F.col(best).cast("string"), True).over(whole)
    d = d.withColumns({"_new": F.row_number().over(run.orderBy(*order)) == 1, "_v": first.cast("string"),
                       "_b": F.col(best).cast("string"), "_at": F.unix_micros(F.col(ts).cast("timestamp"))}).drop("_key")
    hold, helpers = int(hold_s * 1_000_000), ("_new", "_v", "_b", "_at")
    schema = T.StructType([*[f for f in d.schema.fields if f.name not in helpers], T.StructField("active", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for batch in batches:
            active = []
            for new, v, b, at in zip(*(batch.column(x).to_pylist() for x in helpers)):
                if new:
                    now, last = v, None
                if b is not None and at is not None and now is not None and b != now and (last is None or at - last >= hold):
                    now, last = b, at
                active.append(now)
            kept = [n for n in batch.schema.names if n not in helpers]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(active, pa.string())], names=[*kept, "active"])

    return d.mapInArrow(scan, schema)


def _long_switch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], best: str, hold_s: float, start: str | None, ts: str) -> DataFrame:
    """``variant_switch`` of runs too long for one task.

    When a switch may happen depends on the switch before; but where a switch at any row would be followed by the next one
    depends on that row alone: on the first later row at least ``hold_s`` on whose best differs. So every row gets that successor by an as-of join, and the
    switches that do happen are those reached from a run's first one, found by doubling the successors: twice as many per
    round. A run is spread over chunks of equal row counts throughout, whatever its length.
    """
    names, at = rows.columns, ["_key", "_i"]
    d = balanced_chunks(with_part(rows, keys, "_key"), ["_key"], order)
    x = written(running(d, ["_key"], order, {"_i": ("sum", F.lit(1))}))
    can = x.where(F.col(best).isNotNull() & F.col(ts).isNotNull()).select(*at, CHUNK, F.col(best).alias("_b"), F.col(ts).cast("timestamp").alias("_at"))
    can = running(can, ["_key"], ["_i"], {"_before": ("last", F.col("_b"))}, exclusive=True)
    # the next row of another variant, per row: the last start of a stretch that a reader from behind has seen
    back = can.withColumns({"_ri": -F.col("_i"), "_rc": -F.col(CHUNK)}).drop(CHUNK)
    other = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_b")), F.struct(F.col("_i").alias("i"), F.col("_b").alias("b")))
    can = written(running(back, ["_key"], ["_ri"], {"_other": ("last", other)}, chunk="_rc", exclusive=True).select(*at, "_b", "_at", "_other"))
    due = can.select(*at, "_b", (F.unix_micros("_at") + F.lit(int(hold_s * 1_000_000))).alias("_due")).withColumn("_due", F.timestamp_micros("_due"))
    row = can.select("_key", "_at", (-F.col("_i")).alias("_ni"), F.col("_b").alias("_kb"), F.struct(F.col("_i").alias("i"), F.col("_b").alias("b")).alias("_self"), "_other")
    hop = can.select(*at, F.col("_other.i").alias("_to")) if hold_s <= 0 else asof_forward(due, row, ["_key"], left_ts="_due", right_ts="_at", take={"_kb": "_kb", "_self": "_self", "_next": "_other"}, right_tie=["_ni"]).select(
        *at, F.when(F.col("_kb") != F.col("_b"), F.col("_self.i")).otherwise(F.col("_next.i")).alias("_to"))
    hop = written(hop.where("_to IS NOT NULL"))
    first = x.groupBy("_key").agg(F.min_by(F.col(best), F.when(F.col(best).isNotNull(), F.col("_i"))).alias("_v"))
    first = first.withColumn("_v", F.lit(start) if start is not None else F.col("_v"))
    opening = can.groupBy("_key").agg(F.min_by(F.struct("_i", "_b", "_other"), "_i").alias("_o")).join(first, "_key")
    opening = opening.select("_key", F.when(F.col("_o._b") != F.col("_v"), F.col("_o._i")).otherwise(F.col("_o._other.i")).alias("_i")).where("_i IS NOT NULL")
    reached = fresh = written(opening)
    while True:
        fresh = written(reached.join(hop, at).select("_key", F.col("_to").alias("_i")).join(reached, at, "left_anti"))
        if fresh.isEmpty():
            break
        reached = written(reached.unionByName(fresh))
        hop = written(hop.join(hop.select("_key", F.col("_i").alias("_to"), F.col("_to").alias("_far")), ["_key", "_to"]).select(*at, F.col("_far").alias("_to")))
    marked = x.join(reached.withColumn("_switch", F.lit(True)), at, "left").join(first, "_key")
    out = running(marked, ["_key"], ["_i"], {"_now": ("last", F.when(F.col("_switch"), F.col(best)))})
    return out.select(*names, F.coalesce("_now", "_v").cast("string").alias("active"))
