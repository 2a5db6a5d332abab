"""Wallet activity, leader scores and leader-weighted side flow."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import ColumnOrName, c, clamp, div_or, epoch_s, round_to, sum_if
from ..functions.normalize import classify_activity, norm_wallet


def _with_class(activity: DataFrame, side_default_buy: bool) -> DataFrame:
    return (activity.where(F.col("condition_id").isNotNull())
            .withColumn("_cls", classify_activity("type", "side", side_default_buy=side_default_buy))
            .withColumn("_usdc", F.greatest(F.lit(0.0), F.coalesce(F.col("usdc_size"), F.lit(0.0)))))


def wallet_market_fold(activity: DataFrame, *, side_default_buy: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (wallet, market): bought, redeemed, last purchase in epoch seconds.

    The group is as small as a market position and partial aggregation runs before the shuffle, so
    a wallet or market with a large share of rows costs no more than its positions.
    """
    buy, red = F.col("_cls") == "BUY", F.col("_cls") == "REDEEM"
    return (_with_class(activity, side_default_buy).where(buy | red)
            .groupBy("wallet", "condition_id", *by)
            .agg(sum_if(buy, "_usdc").alias("buy"), sum_if(red, "_usdc").alias("redeem"),
                 F.coalesce(F.max(F.when(buy, epoch_s("ts"))), F.lit(0.0)).alias("last_buy_s")))


def _settled_aggs(ok: Column, suffix: str = "") -> list[Column]:
    return [F.count(F.when(ok, 1)).alias(f"settled{suffix}"),
            F.count(F.when(ok & (F.col("redeem") > 0), 1)).alias(f"wins{suffix}"),
            sum_if(ok, "buy").alias(f"_buy{suffix}"), sum_if(ok, "redeem").alias(f"_red{suffix}")]


def _rates(df: DataFrame, suffix: str = "") -> DataFrame:
    buy, red = F.col(f"_buy{suffix}"), F.col(f"_red{suffix}")
    return df.withColumns({
        f"wr{suffix}": div_or(f"wins{suffix}", f"settled{suffix}", 0.0),
        f"roi{suffix}": F.when(buy > 0, F.try_divide(red - buy, buy)).otherwise(F.lit(-1.0)),
    }).drop(f"_buy{suffix}", f"_red{suffix}")


def wallet_score(fold: DataFrame, now_s: ColumnOrName | float, *, lag_s: float = 1200, min_bet: float = 1.0) -> DataFrame:
    """Per wallet: settled markets, wins, win rate, return on stake (-1 without purchases)."""
    ok = (F.col("buy") >= min_bet) & (c(now_s) - F.col("last_buy_s") >= lag_s)
    return _rates(fold.groupBy("wallet").agg(*_settled_aggs(ok)))


def wallet_score_window(activity: DataFrame, now_s: float, *, window_s: float = 86_400, lag_s: float = 1200,
                        min_bet: float = 1.0) -> DataFrame:
    """Rolling variant: only events of the last ``window_s`` seconds; a missing side is no purchase."""
    t = epoch_s("ts")
    recent = activity.where((t > 0) & (F.lit(now_s) - t <= window_s))
    return wallet_score(wallet_market_fold(recent, side_default_buy=False), now_s, lag_s=lag_s, min_bet=min_bet)


def rolling_score(wr: ColumnOrName, roi: ColumnOrName, settled: ColumnOrName, market_trades: ColumnOrName,
                  min_roi: float = 0.02) -> Column:
    """Score of a currently winning wallet from its rolling window."""
    return (clamp((c(wr) - 0.50) / 0.30, 0, 1) * 0.45 + clamp((c(roi) - min_roi) / 0.50, 0, 1) * 0.35
            + F.least(F.lit(1.0), F.log1p(c(settled)) / math.log1p(80)) * 0.10
            + F.least(F.lit(1.0), c(market_trades) / 12.0) * 0.10)


def leader_composite(wr: ColumnOrName, roi: ColumnOrName, same_side_ratio: ColumnOrName, settled: ColumnOrName) -> Column:
    """Composite growth score: outcome quality, efficiency, affinity, sample size."""
    return (clamp((c(wr) - 0.45) / 0.20, 0, 1) * 0.45 + clamp((c(roi) + 0.20) / 0.60, 0, 1) * 0.25
            + clamp((c(same_side_ratio) - 0.45) / 0.25, 0, 1) * 0.20
            + clamp(F.log1p(c(settled)) / math.log1p(60), 0, 1) * 0.10)


def family_join(activity: DataFrame, families: DataFrame, targets: tuple[str, ...] | None = None) -> DataFrame:
    """Activity with the ``family`` of its market; ``families`` is unique per condition_id.

    No broadcast hint: the market dimension grows with history, so Spark decides by its size.
    """
    out = activity.join(families.select("condition_id", "family"), "condition_id", "inner")
    return out.where(F.col("family").isin(*targets)) if targets else out


def unknown_markets(activity: DataFrame, families: DataFrame) -> DataFrame:
    """Markets in the activity with no known family (distinct before the anti join)."""
    return (activity.where(F.col("condition_id").isNotNull()).select("condition_id").distinct()
            .join(families.select("condition_id"), "condition_id", "left_anti"))


def wallet_family_metrics(activity_with_family: DataFrame, now_s: float, *, window_s: float = 86_400,
                          lag_s: float = 1200, min_bet: float = 1.0) -> DataFrame:
    """Rolling-window and all-time results per (wallet, family) in one pass."""
    fold = wallet_market_fold(activity_with_family, side_default_buy=False, by=("family",))
    age = F.lit(now_s) - F.col("last_buy_s")
    ok = (F.col("buy") >= min_bet) & (age >= lag_s)
    out = fold.groupBy("wallet", "family").agg(*_settled_aggs(ok, "_all"), *_settled_aggs(ok & (age <= window_s), "_24h"))
    return _rates(_rates(out, "_all"), "_24h")


def family_score(min_roi: float = 0.02) -> Column:
    """Score of a wallet within one family, from ``wallet_family_metrics`` columns."""
    return ((clamp((F.col("wr_24h") - 0.50) / 0.30, 0, 1) * 0.35
             + clamp((F.col("roi_24h") - min_roi) / 0.50, 0, 1) * 0.30
             + F.least(F.lit(1.0), F.log1p("settled_24h") / math.log1p(40)) * 0.10)
            + (clamp((F.col("wr_all") - 0.50) / 0.30, 0, 1) * 0.15
               + clamp((F.col("roi_all") + 0.05) / 0.55, 0, 1) * 0.05
               + F.least(F.lit(1.0), F.log1p("settled_all") / math.log1p(180)) * 0.05))


def own_sides(trades: DataFrame, own_wallet: ColumnOrName | str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Per market, the side of the wallet's last purchase in ``order``: (condition_id, own_side)."""
    own = trades.where((F.upper("side") == "BUY") & (F.coalesce("outcome", F.lit("")) != "")
                       & (F.col("wallet") == own_wallet))
    return own.groupBy("condition_id").agg(F.max_by("outcome", F.struct(*order)).alias("own_side"))


def market_wallet_buys(trades: DataFrame) -> DataFrame:
    """Purchases pre-aggregated to (market, wallet, outcome): the input of every peer operator."""
    usdc = F.greatest(F.lit(0.0), F.coalesce(F.col("price") * F.col("size"), F.lit(0.0)))
    return (trades.where((F.upper("side") == "BUY") & F.col("wallet").isNotNull())
            .groupBy("condition_id", "wallet", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(usdc).alias("usdc")))


def peer_trades(trades: DataFrame, own: DataFrame, own_wallet: ColumnOrName | str) -> DataFrame:
    """Other wallets' purchases on the wallet's markets, with a same-side flag."""
    return (market_wallet_buys(trades).where(F.col("wallet") != own_wallet)
            .join(own, "condition_id")
            .withColumn("same_side", (F.coalesce("outcome", F.lit("")) != "") & (F.col("outcome") == F.col("own_side"))))


def peer_affinity(peers: DataFrame) -> DataFrame:
    """Per peer: trades, value and same-side share on shared markets."""
    return (peers.groupBy("wallet").agg(
        F.sum("n").alias("same_market_trades"), F.sum("usdc").alias("same_market_usdc"),
        F.coalesce(F.sum(F.when(F.col("same_side"), F.col("n"))), F.lit(0)).alias("same_side"))
        .withColumn("same_side_ratio", div_or("same_side", "same_market_trades", 0.5)))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of an order (TakeOrderedAndProject; nothing is globally sorted)."""
    return df.orderBy(*order).limit(k)


def top_candidates(affinity: DataFrame, k: int = 80) -> DataFrame:
    return top_k(affinity, k, F.desc("same_market_trades"), F.desc("same_market_usdc"), F.asc("wallet"))


def top_leaders(scored: DataFrame, k: int = 18) -> DataFrame:
    return top_k(scored, k, F.desc("score"), F.asc("wallet"))


def merge_leaders(static: DataFrame, live: DataFrame) -> DataFrame:
    """Static and live leader weights, the greater one per wallet."""
    a, b = static.select("wallet", F.col("score").alias("_a")), live.select("wallet", F.col("score").alias("_b"))
    return a.join(b, "wallet", "full_outer").select(
        "wallet", F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))).alias("score"))


def family_weight(trades_with_family: DataFrame, leaders: DataFrame, family_scores: DataFrame) -> DataFrame:
    """Trades with the weight of their wallet: general score or 1.35 x family score."""
    return (trades_with_family.join(leaders.select("wallet", F.col("score").alias("_g")), "wallet", "left")
            .join(family_scores.select("wallet", "family", F.col("score").alias("_f")), ["wallet", "family"], "left")
            .withColumn("weight", F.greatest(F.coalesce("_g", F.lit(0.0)), F.coalesce("_f", F.lit(0.0)) * 1.35))
            .drop("_g", "_f"))


def leader_trades(trades: DataFrame, leaders: DataFrame) -> DataFrame:
    """Leader purchases with the leader's weight. The join side is left to Spark's size check: ``leaders`` may be a top-k
    list or every wallet."""
    w = leaders.select("wallet", F.col("score").alias("weight"))
    return trades.where(F.upper("side") == "BUY").join(w, "wallet")


def _flow(df: DataFrame) -> DataFrame:
    s = F.col("_up") + F.col("_dn")
    return df.where(s > 0).withColumns({
        "up": round_to(F.col("_up") / s, 4), "down": round_to(F.col("_dn") / s, 4),
        "n": F.bround(F.round(s * 10, 8), 0).cast("bigint")}).drop("_up", "_dn")


def market_side_flow(weighted: DataFrame) -> DataFrame:
    """Leader-weighted Up/Down share per market; markets without directed flow are dropped."""
    return _flow(weighted.groupBy("condition_id").agg(
        sum_if(F.col("outcome") == "Up", "weight").alias("_up"),
        sum_if(F.col("outcome") == "Down", "weight").alias("_dn")))


def leader_style(weighted: DataFrame) -> DataFrame:
    """Side flow plus how leaders buy: entry in cents, cheap / dear share, repeat-buyer ratio.

    First level groups by (market, wallet), so one busy market is spread over its wallets.
    """
    px, w = F.col("price"), F.col("weight")
    per_wallet = weighted.where(w > 0).groupBy("condition_id", "wallet").agg(
        sum_if(F.col("outcome") == "Up", "weight").alias("u"), sum_if(F.col("outcome") == "Down", "weight").alias("d"),
        sum_if(px > 0, px * w).alias("pw"), sum_if(px > 0, "weight").alias("wp"),
        sum_if((px > 0) & (px <= 0.30), "weight").alias("lo"), sum_if(px >= 0.70, "weight").alias("hi"),
        F.count(F.lit(1)).alias("k"))
    agg = per_wallet.groupBy("condition_id").agg(
        F.sum("u").alias("_up"), F.sum("d").alias("_dn"), F.sum("pw").alias("_pw"), F.sum("wp").alias("_wp"),
        F.sum("lo").alias("_lo"), F.sum("hi").alias("_hi"),
        F.count(F.when(F.col("k") >= 2, 1)).alias("_multi"), F.count(F.lit(1)).alias("_wallets"))
    den = F.greatest(F.lit(1e-9), F.col("_wp"))
    return _flow(agg).withColumns({
        "avg_entry_c": round_to(div_or("_pw", "_wp", 0.0) * 100, 1),
        "low_c_share": round_to(F.col("_lo") / den, 4), "high_c_share": round_to(F.col("_hi") / den, 4),
        "multibet_ratio": round_to(F.col("_multi") / F.greatest(F.lit(1), F.col("_wallets")), 4),
    }).drop("_pw", "_wp", "_lo", "_hi", "_multi", "_wallets")


def bet_stats(activity: DataFrame) -> DataFrame:
    """Bets and wins per wallet: a market bought, and bought and redeemed."""
    t = F.upper("type")
    per = activity.where(F.col("condition_id").isNotNull()).groupBy("wallet", "condition_id").agg(
        F.bool_or(t.isin("BUY", "TRADE", "PURCHASE")).alias("b"), F.bool_or(t == "REDEEM").alias("r"))
    return per.groupBy("wallet").agg(F.count_if(F.col("b")).alias("bets"), F.count_if(F.col("b") & F.col("r")).alias("wins"))


def last5_streak(activity: DataFrame, open_markets: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Last k finished bets per wallet as a W/L string, newest first.

    A market counts at the time of its newest event; open markets are skipped.
    """
    t = F.upper("type")
    per = activity.where(F.col("condition_id").isNotNull()).groupBy("wallet", "condition_id").agg(
        F.bool_or(t.isin("BUY", "TRADE", "PURCHASE")).alias("b"), F.bool_or(t == "REDEEM").alias("r"),
        F.max(F.struct("ts", "event_id")).alias("_at")).where("b")
    if open_markets is not None:
        per = per.join(open_markets.select("condition_id").distinct(), "condition_id", "left_anti")
    # row_number <= k is limited per map task before the shuffle (window group limit).
    last = per.withColumn("rn", F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("_at")))).where(F.col("rn") <= k)
    return last.groupBy("wallet").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.when(F.col("r"), "W").otherwise("L").alias("x")))),
                                 lambda s: s["x"]), "").alias("streak"),
        F.count(F.lit(1)).alias("bets"), F.count_if(F.col("r")).alias("wins"))


def net_holdings(activity: DataFrame) -> DataFrame:
    """Signed size per (market, outcome) with an any-redeem flag per market."""
    t = F.upper("type")
    trade = t.isin("BUY", "TRADE", "PURCHASE") & (F.coalesce("outcome", F.lit("")) != "") & (F.col("size") > 0)
    signed = F.when(F.upper(F.coalesce("side", F.lit("BUY"))) == "BUY", F.col("size")).otherwise(-F.col("size"))
    return activity.where(F.col("condition_id").isNotNull()).groupBy("condition_id").agg(
        sum_if(trade & (F.col("outcome") == "Up"), signed).alias("net_up"),
        sum_if(trade & (F.col("outcome") == "Down"), signed).alias("net_down"),
        F.bool_or(t == "REDEEM").alias("redeemed"))


def norm_activity(raw: DataFrame) -> DataFrame:
    return raw.withColumn("wallet", norm_wallet("wallet"))
