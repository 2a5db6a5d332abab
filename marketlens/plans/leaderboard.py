"""Leader board: peers on a wallet's markets, scored by their own results, then their side flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import wallets as W


def peers_of(trades: DataFrame, own_wallet, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Purchases on the wallet's own markets, folded once to (market, wallet, outcome): input of affinity and flow."""
    return W.peer_trades(trades, W.own_sides(trades, own_wallet, order), own_wallet)


def leaders_of(peers: DataFrame, activity: DataFrame, now_s: float, *, lag_s: float = 3600, min_bet: float = 2.0, min_settled: int = 8,
               min_roi: float = -0.05, candidates: int | None = None, top: int = 18) -> DataFrame:
    """Top wallets by composite score among all peers; ``candidates`` keeps only that many of the busiest, if given."""
    cand = W.peer_affinity(peers).withColumn("same_market_usdc", F.round("same_market_usdc", 4))
    if candidates is not None:
        cand = W.top_candidates(cand, candidates)
    scored = W.wallet_score(W.wallet_market_fold(activity), now_s, lag_s=lag_s, min_bet=min_bet)
    out = (cand.join(scored, "wallet").where((F.col("settled") >= min_settled) & (F.col("roi") >= min_roi))
           .withColumn("score", F.round(W.leader_composite("wr", "roi", "same_side_ratio", "settled"), 9)))
    return W.top_leaders(out, top)


def leaders(trades: DataFrame, activity: DataFrame, own_wallet, now_s: float, *, order: Sequence[str] = ("ts",), **kw) -> DataFrame:
    return leaders_of(peers_of(trades, own_wallet, order), activity, now_s, **kw)


def build_leaderboard(trades: DataFrame, activity: DataFrame, own_wallet, now_s: float, *, order: Sequence[str] = ("ts",),
                      **kw) -> tuple[DataFrame, DataFrame]:
    """(leaders, leader-weighted side flow per market the wallet bought into)."""
    peers = peers_of(trades, own_wallet, order)
    lead = leaders_of(peers, activity, now_s, **kw)
    weighted = peers.join(lead.select("wallet", "score"), "wallet").withColumn("weight", F.col("score") * F.col("n"))
    return lead, W.market_side_flow(weighted)
