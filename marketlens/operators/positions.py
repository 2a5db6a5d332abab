"""Positions: snapshots, reconciliation, exposure, claims, settlement queue, equity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import ColumnOrName, c, epoch_s, sum_if
from ..functions.normalize import SIDE_TYPES, outcome_side, winner_by_payout
from ..functions.prob import pnl_binary
from .ordered import block_window, lookback, own_rows


def counted(positions: DataFrame, min_value: float = 0.01) -> DataFrame:
    """Positions with an outcome and a value worth reporting."""
    return positions.where((F.coalesce("outcome", F.lit("")) != "") & (F.coalesce("current_value", F.lit(0.0)) >= min_value))


def open_redeemable_summary(positions: DataFrame, by: Sequence[str], min_value: float = 0.01) -> DataFrame:
    """Counts and values of open and redeemable positions."""
    red = F.coalesce(F.col("redeemable"), F.lit(False))
    return counted(positions, min_value).groupBy(*by).agg(
        F.count_if(~red).alias("open_n"), F.count_if(red).alias("redeem_n"),
        F.round(sum_if(~red, "current_value"), 4).alias("open_value"),
        F.round(sum_if(red, "current_value"), 4).alias("redeem_value"))


def top_positions(positions: DataFrame, k: int = 8, *, redeemable: bool | None = None) -> DataFrame:
    p = counted(positions)
    if redeemable is not None:
        p = p.where(F.coalesce(F.col("redeemable"), F.lit(False)) == redeemable)
    return p.orderBy(F.desc("current_value"), F.asc("condition_id")).limit(k)


def position_changes(snapshots: DataFrame, *, keys: Sequence[str] = ("wallet",), ts: str = "snapshot_ts", width_s: float | None = None,
                     block: int = 65_536) -> DataFrame:
    """Snapshots whose signature (counts and values) differs from the previous one."""
    sig = open_redeemable_summary(snapshots, [*keys, ts])
    d = lookback(sig, keys, [ts], 1, ts=ts, width_s=width_s, block=block)
    s = F.struct("open_n", "open_value", "redeem_n", "redeem_value")
    prev = F.lag(s).over(block_window(keys))
    return own_rows(d.withColumn("changed", prev.isNull() | (prev != s)))


def reconcile_positions(pending: DataFrame, venue: DataFrame, now_s: float, *, min_value: float = 0.50, grace_s: float = 90,
                        queued: DataFrame | None = None, redeemed: DataFrame | None = None) -> DataFrame:
    """Local pending rows against the venue snapshot: exactly one action per market.

    redeem / loss for positions the venue resolved, recover for open ones not known locally, prune for
    stale local rows, keep otherwise; queued or already redeemed markets are never recovered.
    ``pending`` has (condition_id, placed_s, end_s), ``venue`` is unique per market.
    """
    p = pending.select("condition_id", F.lit(True).alias("_p"), "placed_s", "end_s")
    v = venue.select("condition_id", F.lit(True).alias("_v"), "outcome", "current_value", "redeemable", "size")
    j = p.join(v, "condition_id", "full_outer")
    done = F.lit(False)
    if queued is not None:
        j = j.join(queued.select("condition_id", F.lit(True).alias("_q")), "condition_id", "left")
        done = done | F.col("_q").isNotNull()
    else:
        j = j.withColumn("_q", F.lit(None).cast("boolean"))
    if redeemed is not None:
        j = j.join(redeemed.select("condition_id", F.lit(True).alias("_r")), "condition_id", "left")
        done = done | F.col("_r").isNotNull()
    local, there = F.col("_p").isNotNull(), F.col("_v").isNotNull()
    red, named = F.coalesce("redeemable", F.lit(False)), F.coalesce("outcome", F.lit("")) != ""
    live = there & ~red & named & (F.col("current_value") >= min_value)
    placed, end = F.coalesce("placed_s", F.lit(0.0)), F.coalesce("end_s", F.lit(0.0))
    fresh = ((placed > 0) & (now_s - placed < grace_s)) | ((end > now_s) & (end - now_s < grace_s))
    action = (F.when(local & there & red & (F.col("current_value") >= 0.01) & F.col("_q").isNull(), "redeem")
              .when(local & there & red, "loss")
              .when(local & (live | F.col("_q").isNotNull() | fresh), "keep")
              .when(local, "prune")
              .when(there & red & named & (F.col("current_value") >= 0.01) & ~done, "queue_redeem")
              .when(live & ~done, "recover").otherwise("ignore"))
    entry = F.when(F.col("size") > 0, F.try_divide(F.col("current_value"), F.col("size"))).otherwise(F.lit(0.5))
    return j.select("condition_id", action.alias("action"), F.when(action == "recover", entry).alias("recovered_entry"))


def settlement_queue(pending: DataFrame, settled: DataFrame, now_s: float) -> DataFrame:
    """Rows ended by ``now`` that are not settled yet (idempotent: a settled market never returns)."""
    return pending.where((F.col("end_s") > 0) & (F.col("end_s") <= now_s)).join(
        settled.select("condition_id").distinct(), "condition_id", "left_anti")


def open_position_view(positions: DataFrame, now_s: float) -> DataFrame:
    """Projected winner, LEAD / TRAIL, move, estimated payout and minutes left of open positions.

    Expects side, size, entry, open_price, oracle, tick, end_s.
    """
    cur = F.when(F.coalesce("oracle", F.lit(0.0)) > 0, F.col("oracle")).otherwise(F.coalesce("tick", F.lit(0.0)))
    ref = (F.coalesce("open_price", F.lit(0.0)) > 0) & (cur > 0)
    winner = F.when(ref, F.when(cur >= F.col("open_price"), "Up").otherwise("Down"))
    lead = winner == F.col("side")
    return positions.withColumns({
        "status": F.when(ref, "LIVE").otherwise("UNSETTLED"), "projected": winner,
        "standing": F.when(lead, "LEAD").when(ref, "TRAIL").otherwise("NA"),
        "move_pct": F.when(ref, (cur - F.col("open_price")) / F.col("open_price") * 100.0),
        "payout_est": F.when(lead, F.col("size") / F.col("entry")).otherwise(F.lit(0.0)),
        "mins_left": F.greatest(F.lit(0.0), (F.col("end_s") - now_s) / 60.0)})


def local_counts(pending: DataFrame, redeem_queue: DataFrame, now_s: float) -> DataFrame:
    """Open local rows (no end, or ending later) and length of the redeem queue."""
    e = F.coalesce("end_s", F.lit(0.0))
    a = pending.agg(F.count_if((e <= 0) | (e > now_s)).alias("open_local"))
    b = redeem_queue.agg(F.count(F.lit(1)).alias("settling_local"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def cross_asset_agreement(open_rounds: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Other open rounds of the slot above / below their own open, without a self join.

    Two-step totals: partial counts per slot join back to the rows; nothing is paired.
    """
    ok = (F.col("open") > 0) & (F.col("price") > 0)
    ok = F.coalesce(ok, F.lit(False))
    up = ok & (F.col("price") > F.col("open"))
    x = open_rounds.withColumns({"_u": F.when(up, 1).otherwise(0).cast("bigint"), "_d": F.when(ok & ~up, 1).otherwise(0).cast("bigint")})
    all_ = x.groupBy(*slot).agg(F.sum("_u").alias("_su"), F.sum("_d").alias("_sd"))
    own = x.groupBy(*slot, "asset").agg(F.sum("_u").alias("_ou"), F.sum("_d").alias("_od"))
    return (x.join(all_, list(slot)).join(own, [*slot, "asset"])
            .withColumn("others_up", F.col("_su") - F.col("_ou")).withColumn("others_down", F.col("_sd") - F.col("_od"))
            .drop("_u", "_d", "_su", "_sd", "_ou", "_od"))


def same_round_exposure(open_trades: DataFrame, *, fingerprint: str = "fingerprint") -> DataFrame:
    """Each open trade with the other stakes and legs of its round, same side and opposite.

    Totals are pre-aggregated per (round, side) and joined back.
    """
    size = F.greatest(F.lit(0.0), F.coalesce("size", F.lit(0.0)))
    per = open_trades.groupBy(fingerprint).agg(
        sum_if(F.col("side") == "Up", size).alias("_up"), sum_if(F.col("side") != "Up", size).alias("_dn"),
        F.count_if(F.col("side") == "Up").alias("_nu"), F.count_if(F.col("side") != "Up").alias("_nd"))
    up = F.col("side") == "Up"
    return open_trades.join(per, fingerprint).withColumns({
        "same_side_size": F.when(up, F.col("_up")).otherwise(F.col("_dn")) - size,
        "opp_side_size": F.when(up, F.col("_dn")).otherwise(F.col("_up")),
        "same_side_legs": F.when(up, F.col("_nu")).otherwise(F.col("_nd")) - 1,
        "round_legs": F.col("_nu") + F.col("_nd") - 1}).drop("_up", "_dn", "_nu", "_nd")


def cid_side_universe(activity: DataFrame, pending: DataFrame, metrics: DataFrame) -> DataFrame:
    """Distinct (condition_id, side, source) of the three sources a redeem scan reads."""
    typ = F.upper(F.coalesce("type", F.lit("")))
    side = outcome_side("outcome", "side")
    pick = lambda df, s, src: df.select("condition_id", s.alias("side"), F.lit(src).alias("source"))
    a = pick(activity.where(typ.isin(*SIDE_TYPES)), side, "activity")
    b = pick(pending, F.initcap("side"), "pending_file")
    m = pick(metrics, F.initcap("side"), "metrics_file")
    return a.unionByName(b).unionByName(m).where(F.col("condition_id").isNotNull() & F.col("side").isin("Up", "Down")).distinct()


def claimable(universe: DataFrame, payouts: DataFrame, balances: DataFrame) -> DataFrame:
    """Sides that won and still hold tokens.

    ``payouts`` is unique per market, ``balances`` per (market, side); the winner filter runs before
    the second join.
    """
    w = payouts.select("condition_id", winner_by_payout("denom", "n0", "n1").alias("winner")).where("winner IS NOT NULL")
    return (universe.select("condition_id", "side").distinct().join(w, "condition_id").where(F.col("side") == F.col("winner"))
            .join(balances.where(F.col("qty") > 0), ["condition_id", "side"]).select("condition_id", "side", "winner", "qty"))


def redeem_report(universe: DataFrame, claims: DataFrame, redeemed: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts by source and by stage as (kind, name, n)."""
    kind = lambda df, k, n: df.groupBy(F.lit(k).alias("kind"), n.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    src = (universe.groupBy("source").agg(F.count_distinct("condition_id").alias("n"))
           .select(F.lit("source").alias("kind"), F.col("source").alias("name"), "n"))
    return src.unionByName(kind(claims, "stage", F.lit("claimable"))).unionByName(
        kind(redeemed, "stage", F.lit("redeemed"))).unionByName(kind(errors, "stage", F.lit("errors")))


def equity_summary(cash: ColumnOrName | float, holdings: DataFrame, claims: DataFrame, by: Sequence[str] = (), *,
                   baseline: float = 0.0) -> DataFrame:
    """Cash + open quantity x price + claimable quantity, with counts and pnl since a baseline.

    A missing token price falls back to the round's up price (1 - p for Down). Both sides are
    aggregated to one row per group before they meet.
    """
    fall = F.when(F.col("side") == "Up", F.col("up_price")).otherwise(F.greatest(F.lit(0.0), 1 - F.col("up_price")))
    px = F.when(F.coalesce("token_price", F.lit(0.0)) > 0, F.col("token_price")).otherwise(fall)
    h = holdings.where(F.col("qty") > 0).groupBy(*by).agg(F.sum(F.col("qty") * px).alias("open_value"), F.count(F.lit(1)).alias("open_n"))
    k = claims.where(F.col("qty") > 0).groupBy(*by).agg(F.sum("qty").alias("claim_value"), F.count(F.lit(1)).alias("claim_n"))
    if by:
        j = h.join(k, list(by), "full_outer")
    else:
        j = h.withColumn("_k", F.lit(1)).join(k.withColumn("_k", F.lit(1)), "_k", "full_outer").drop("_k")
    j = j.fillna(0).fillna(0.0)
    total = F.round(c(cash) + F.col("open_value") + F.col("claim_value"), 2)
    return j.withColumn("equity", total).withColumn("pnl", F.round(F.col("equity") - baseline, 2))


def core_addon_split(entries: DataFrame) -> DataFrame:
    """Per market: the core entry stays as first filled; add-ons are counted and their stake summed."""
    addon = F.coalesce("is_addon", F.lit(False))
    first = F.min_by(F.struct("size", "entry"), F.when(~addon, F.struct("ts", "seq")))
    return (entries.groupBy("condition_id").agg(first.alias("_c"), F.count_if(addon).alias("addon_count"), sum_if(addon, "size").alias("addon_stake"))
            .select("condition_id", F.col("_c.size").alias("core_size"), F.col("_c.entry").alias("core_entry"), "addon_count",
                    F.round("addon_stake", 6).alias("addon_stake")))


def paper_resolve(expired: DataFrame) -> DataFrame:
    """Outcome, fee and profit of expired rows from open and close (a tie goes Up)."""
    up = F.col("close") >= F.col("open")
    won = F.when(F.col("side") == "Up", up).otherwise(~up)
    fee = F.when(F.col("won"), F.col("size") * 0.0156 * (1.0 - F.abs(F.col("mkt_price") - 0.5) * 2.0)).otherwise(F.lit(0.0))
    return (expired.withColumn("won", won).withColumn("fee", fee)
            .withColumn("pnl", pnl_binary("won", "size", "entry") - F.col("fee"))
            .withColumn("result", F.when(F.col("won"), "WIN").otherwise("LOSS")))


def prebid_arm(flow: DataFrame, rounds: DataFrame, *, min_conf: float = 0.58, lead_s: float = 120, valid_s: float = 30) -> DataFrame:
    """Rounds armed before their start by leader flow seen in the last ``lead_s`` seconds.

    The newest flow row in the interval decides. Adds side, confidence and validity bounds.
    """
    t, st = epoch_s("ts"), epoch_s("start_ts")
    j = flow.join(rounds, "condition_id").where((t < st) & (st - t <= lead_s) & (F.col("up") + F.col("down") > 0)
                                                & (F.greatest("up", "down") >= min_conf))
    last = j.groupBy("condition_id", "start_ts").agg(F.max_by(F.struct("up", "down"), F.col("ts")).alias("_f"))
    s = epoch_s("start_ts")
    return last.select("condition_id", "start_ts", F.when(F.col("_f.up") >= F.col("_f.down"), "Up").otherwise("Down").alias("side"),
                       F.greatest("_f.up", "_f.down").alias("conf"), s.alias("valid_from_s"), (s + valid_s).alias("valid_to_s"))


def retry_cooldown(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], *, cooldown_s: float = 12, ts: str = "ts",
                   width_s: float | None = None, block: int = 65_536) -> DataFrame:
    """Attempts with ``blocked``: another attempt of the same round and side came too shortly before."""
    d = lookback(attempts, keys, order, 1, ts=ts, width_s=width_s, block=block)
    prev = F.lag(epoch_s(ts)).over(block_window(keys))
    return own_rows(d.withColumn("blocked", F.coalesce(epoch_s(ts) - prev < cooldown_s, F.lit(False))))


def order_status_fold(events: DataFrame) -> DataFrame:
    """Latest status per order and the value filled so far."""
    at = F.struct("ts", "seq")
    filled = F.max("filled_shares")
    return events.groupBy("order_id").agg(
        F.max_by("status", at).alias("status"), filled.alias("filled_shares"), F.max_by("price", at).alias("price"),
        F.max("size").alias("size")).withColumns({
            "filled_usdc": F.col("filled_shares") * F.col("price"),
            "state": F.when(F.col("filled_shares") <= 0, "none").when(F.col("filled_shares") + 1e-9 < F.col("size"), "partial").otherwise("filled")})


def round_best(signals: DataFrame, round_cols: Sequence[str], score: ColumnOrName = "growth", tie: Sequence[str] = ()) -> DataFrame:
    """Best signal per round and duration class (``row_number = 1`` is cut before the shuffle)."""
    cls = F.when(F.col("duration") <= 5, "5m").otherwise("15m")
    d = signals.withColumn("duration_class", cls)
    w = Window.partitionBy(*round_cols, "duration_class").orderBy(c(score).desc(), *tie)
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exposure_caps(regimes: DataFrame, by: Sequence[str], *, trend: tuple[float, float] = (0.80, 0.55),
                  chop: tuple[float, float] = (0.60, 0.40)) -> DataFrame:
    """Total and side caps: trending when at least half of the assets trend."""
    t = (F.col("vr") > 1.02) & (F.col("ac") > 0.02)
    g = regimes.groupBy(*by).agg(F.count_if(t).alias("trending"), F.count(F.lit(1)).alias("assets"))
    is_trend = F.col("trending") >= F.greatest(F.lit(1), F.floor(F.col("assets") / 2))
    return g.withColumns({"total_cap": F.when(is_trend, trend[0]).otherwise(chop[0]), "side_cap": F.when(is_trend, trend[1]).otherwise(chop[1])})


def pick_with_caps(signals: DataFrame, slot: Sequence[str], *, bankroll: float, max_open: int = 8, max_cid_pct: float = 0.10,
                   total_cap: float | str = 0.60, side_cap: float | str = 0.40, open_positions: DataFrame | None = None) -> DataFrame:
    """Greedy picks per decision time in rank order, skipping signals that break a cap.

    ``open_positions`` (slot columns, condition_id, fingerprint, side, size) are those held at each decision time: they
    take slots and count towards every cap before the first signal. ``total_cap`` and ``side_cap`` are shares of the
    bankroll, or names of columns that hold them per decision time (``exposure_caps``).

    Greedy picks depend on order. Partitions hold whole decision times sorted by rank and stream through
    Arrow batches, so no decision time is collected; the running totals are the only state. Expects
    rank, condition_id, fingerprint, side, size.
    """
    slot, names = list(slot), signals.columns
    share = lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x))
    d = signals.withColumns({"_held": F.lit(False), "_tc": share(total_cap), "_sc": share(side_cap)})
    if open_positions is not None:
        d = d.unionByName(open_positions.select(*slot, "condition_id", "fingerprint", "side", "size").withColumn("_held", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, n, used = None, 0.0, 0, {}
        for pdf in batches:
            keep = []
            for at, cid, fp, side, size, held, tc, sc in zip(pdf[slot].itertuples(index=False, name=None), *(pdf[x] for x in ("condition_id", "fingerprint", "side", "size", "_held", "_tc", "_sc"))):
                if at != now:
                    now, total, n, used = at, 0.0, 0, {}
                other, size = "Down" if side == "Up" else "Up", max(0.0, size)
                mine = [("cid", cid, side), ("round", fp, side)]
                ok = held or (n < max_open and not used.get(("cid", cid, other)) and not used.get(("round", fp, other))
                      and all(k not in used or used[k] + size <= bankroll * max_cid_pct for k in mine)
                      and total + size <= bankroll * tc and used.get(("side", side), 0.0) + size <= bankroll * sc)
                keep.append(ok and not held)
                if ok:
                    total, n = total + size, n + 1
                    for k in (*mine, ("side", side)):
                        used[k] = used.get(k, 0.0) + size
            yield pdf.loc[keep, names]

    d = d.repartition(*slot).sortWithinPartitions(*slot, F.col("_held").desc(), "rank")
    return d.mapInPandas(run, T.StructType(signals.schema.fields))
