"""Schemas of the bronze inputs and silver tables."""

from __future__ import annotations

ACTIVITY = ("id string, transactionHash string, proxyWallet string, conditionId string, type string, side string, outcome string, "
            "usdcSize double, size double, timestamp double, title string")
TRADES = "conditionId string, proxyWallet string, side string, outcome string, price double, size double, timestamp double"
POSITIONS = "conditionId string, outcome string, title string, currentValue double, size double, redeemable boolean"
EVENTS = ("id string, startTime string, endDate string, seriesSlug string, markets array<struct<conditionId: string, slug: string, question: string, "
          "endDate: string, eventStartTime: string, seriesSlug: string, outcomes: string, outcomePrices: string, clobTokenIds: string, closed: boolean>>")
TOKEN_PRICES = "token_id string, history array<struct<t: double, p: double>>"
TICK_MSG = "topic string, ts double, payload struct<symbol: string, value: double>"
BOOK_MSG = "asset string, ts double, tick double, bids array<array<string>>, asks array<array<string>>"
PERP_MSG = "asset string, ts double, mark string, `index` string, funding string"
ORACLE_MSG = "asset string, round_id decimal(25,0), answer decimal(38,0), updated_at double"
PROBES = "endpoint string, latency_ms double, ts double"
METRICS = ("event string, ts string, condition_id string, asset string, side string, duration int, score double, size_usdc double, entry_price double, edge double, "
           "true_prob double, cl_agree boolean, open_price_source string, chainlink_age_s double, onchain_score_adj double, result string, pnl double, "
           "bankroll_after double, slippage_bps double, bucket string, round_key string, order_id string, placed boolean")
# Column order of the trade ledger.
LEDGER = ("time string, market string, asset string, duration string, side string, bet_usdc string, entry string, open_price string, current_price string, "
          "true_prob string, mkt_price string, edge string, mins_left string, order_id string, token_id string, result string, pnl string, bankroll string")
FLOW_DOC = ("generated_at long, wallet string, leaders array<struct<wallet: string, score: double, settled: int, wins: int, wr: double, roi: double, "
            "same_side_ratio: double, same_market_trades: int, same_market_usdc: double>>, market_side_flow map<string, struct<Up: double, Down: double, n: int>>")
PENDING_MARKET = "conditionId string, question string, asset string, duration int, start_ts double, end_ts double, up_price double, token_up string, token_down string"
PENDING_TRADE = "side string, size double, entry double, duration int, asset string, end_ts double, placed_ts double, order_id string, token_id string"
