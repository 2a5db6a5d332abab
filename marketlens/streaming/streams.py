"""Structured Streaming forms of the market operators.

Every function takes a streaming (or batch) DataFrame and returns one; starting a query is the
caller's business. Keys spread state over partitions; watermarks bound it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.smoothing import FILTER_START, TAUS, filter_step
from ..operators.wallets import leader_style


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared checkpoint folder named by the cluster; ``fallback`` only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root


def text_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Raw message lines from landed files (a Kafka source has the same ``value`` column)."""
    r = spark.readStream.format("text")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def round_windows(ticks: DataFrame, minutes: int, *, late: str = "1 minute") -> DataFrame:
    """Tumbling 5- or 15-minute rounds with open, close, high, low and tick count."""
    w = F.window("ts", f"{int(minutes)} minutes")
    return _ohlc(ticks.withWatermark("ts", late).groupBy("asset", w))


def bars_upsert(ticks: DataFrame, width: str = "1 minute", *, late: str = "1 minute") -> DataFrame:
    """Bars that are replaced while open (run in update mode): the newest row per bar is the bar."""
    return _ohlc(ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", width)))


def _ohlc(grouped) -> DataFrame:
    return grouped.agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
                       F.max_by("price", "ts").alias("c"), F.count(F.lit(1)).alias("n")).select(
        "asset", F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "o", "h", "l", "c", "n")


def sliding_moves(ticks: DataFrame, span: str = "60 seconds", slide: str = "10 seconds", *, late: str = "30 seconds") -> DataFrame:
    """Move and range over sliding windows."""
    g = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", span, slide))
    return _ohlc(g).withColumn("move", F.col("c") / F.col("o") - 1.0)


def split_late(rows: DataFrame, arrival: str, event_ts: str, max_age_s: float) -> tuple[DataFrame, DataFrame]:
    """(fresh rows, late rows): quotes, oracle answers or flow older than their limit go to a side table."""
    age = (F.unix_micros(F.col(arrival).cast("timestamp")) - F.unix_micros(F.col(event_ts).cast("timestamp"))) / 1e6
    d = rows.withColumn("age_s", age)
    return d.where(F.col("age_s") <= max_age_s), d.where(F.col("age_s") > max_age_s)


def latest_per_market(snapshots: DataFrame, every: str = "250 milliseconds", *, late: str = "5 seconds") -> DataFrame:
    """At most one snapshot per market and interval: the newest one is scored."""
    cols = [x for x in snapshots.columns if x != "condition_id"]
    g = snapshots.withWatermark("ts", late).groupBy("condition_id", F.window("ts", every))
    return g.agg(F.max_by(F.struct(*cols), F.col("ts")).alias("_s")).select("condition_id", "_s.*")


def entry_resolve_stream(entries: DataFrame, resolves: DataFrame, *, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """RESOLVE rows with the last ENTRY of their market inside a time limit, nulls where there is none. A row comes out once
    the watermark shows that no later ENTRY can reach it."""
    e = entries.withWatermark("ts", late).select(F.col("condition_id").alias("_cid"), F.col("ts").alias("_ets"), "score", "open_price_source")
    r = resolves.withWatermark("ts", late)
    both = r.join(e, (F.col("condition_id") == F.col("_cid")) & (F.col("_ets") <= F.col("ts")) & (F.col("_ets") >= F.col("ts") - F.expr(f"INTERVAL {within}")), "leftOuter")
    last = both.groupBy(*resolves.columns).agg(F.max_by(F.struct("_ets", "score", "open_price_source"), "_ets").alias("_e"))
    return last.select(*resolves.columns, "_e._ets", "_e.score", "_e.open_price_source")


def dedupe_seen(rows: DataFrame, key: str, *, within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First row per key inside the watermark."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def flow_refresh(write_to, leaders: DataFrame):
    """``foreachBatch`` function: leader style of the micro-batch's trades handed to ``write_to(df, batch_id)``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        weighted = batch.where(F.upper("side") == "BUY").join(leaders.select("wallet", F.col("score").alias("weight")), "wallet")
        write_to(leader_style(weighted), batch_id)
    return run


_FLOW_OUT = "condition_id string, up double, down double, n long"


def leader_flow_stream(trades: DataFrame, leaders: DataFrame, *, late: str = "10 minutes", idle_s: float = 86_400) -> DataFrame:
    """Leader-weighted Up / Down share of every market over all its purchases so far (update mode).

    State is two sums and the last time per market; it goes once the watermark is ``idle_s`` past the last purchase."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down, last = state.get if state.exists else (0.0, 0.0, 0)
        for pdf in frames:
            up += float(pdf.loc[pdf["outcome"] == "Up", "weight"].sum())
            down += float(pdf.loc[pdf["outcome"] == "Down", "weight"].sum())
            last = max(last, int(pdf["ts"].max().value // 1_000_000))
        state.update((up, down, last))
        state.setTimeoutTimestamp(max(last + int(idle_s * 1000), state.getCurrentWatermarkMs() + 1))
        if up + down > 0:
            s = up + down
            yield pd.DataFrame({"condition_id": [key[0]], "up": [round(round(up / s, 9), 4)], "down": [round(round(down / s, 9), 4)], "n": [round(round(s * 10, 8))]})

    buys = trades.withWatermark("ts", late).where(F.upper("side") == "BUY").join(leaders.select("wallet", F.col("score").alias("weight")), "wallet")
    return buys.select("condition_id", "ts", "outcome", "weight").groupBy("condition_id").applyInPandasWithState(run, _FLOW_OUT, "up double, down double, last_ms long", "update", GroupStateTimeout.EventTimeTimeout)


_KALMAN_OUT = "asset string, ts timestamp, price double, pos double, vel double"


def kalman_stream(ticks: DataFrame, *, late: str = "10 seconds", idle_s: float = 86_400) -> DataFrame:
    """Filtered position and velocity per asset: (asset, ts, price, vol) in, one row per tick out.

    Ticks of a micro-batch are taken in time order; a tick older than the last one used is dropped (the filter cannot go
    back). State goes once the watermark is ``idle_s`` past the last tick."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, *s = state.get if state.exists else (None, *FILTER_START)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            now = row.ts.value / 1e9
            if last is not None and now < last:
                continue
            s = (row.price, *FILTER_START[1:]) if last is None else filter_step(tuple(s), now - last, row.price, row.vol)
            last = now
            out.append((key[0], row.ts, row.price, s[0], s[1]))
        state.update((last, *s))
        state.setTimeoutTimestamp(max(int((last + idle_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["asset", "ts", "price", "pos", "vel"])

    d = ticks.withWatermark("ts", late).select("asset", "ts", "price", "vol").groupBy("asset")
    return d.applyInPandasWithState(run, _KALMAN_OUT, "last_s double, pos double, vel double, p00 double, p01 double, p11 double", "append", GroupStateTimeout.EventTimeTimeout)


_EMA_OUT = "asset string, ts timestamp, price double, " + ", ".join(f"ema_{t} double" for t in TAUS)
_EMA_STATE = "last_s double, " + ", ".join(f"e{t} double" for t in TAUS)


def ema_stream(ticks: DataFrame, *, late: str = "10 seconds", idle_s: float = 86_400) -> DataFrame:
    """Running time-decayed averages per asset; state is one number per time constant.

    A tick older than the last one gets the averages without decay and does not move the clock back. State goes once the
    watermark is ``idle_s`` past the last tick."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values("ts")
        last, *ema = state.get if state.exists else (None, *[0.0] * len(TAUS))
        out = []
        for ts, price in zip(pdf["ts"], pdf["price"]):
            now = ts.value / 1e9
            ema = [price if last is None else e + (1.0 - math.exp(-max(0.0, now - last) / tau)) * (price - e) for e, tau in zip(ema, TAUS)]
            last = now if last is None else max(last, now)
            out.append((key[0], ts, price, *ema))
        state.update((last, *ema))
        state.setTimeoutTimestamp(max(int((last + idle_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["asset", "ts", "price", *[f"ema_{t}" for t in TAUS]])

    d = ticks.withWatermark("ts", late).select("asset", "ts", "price").groupBy("asset")
    return d.applyInPandasWithState(run, _EMA_OUT, _EMA_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_QUEUE_OUT = "condition_id string, end_ts timestamp, status string"


def settlement_stream(pending: DataFrame, *, late: str = "10 seconds", forget_s: float = 86_400) -> DataFrame:
    """Queues every market once its end has passed in event time; a market is queued exactly once.

    ``pending`` has (condition_id, ts, end_ts). Timers fire on the watermark. A settled market is remembered for
    ``forget_s`` of event time, so that rows which repeat until then do not queue it again; then its state goes.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, done = state.get if state.exists else (0, 0)
        forget = lambda: max(end, state.getCurrentWatermarkMs()) + int(forget_s * 1000) + 1
        if state.hasTimedOut and done:
            state.remove()
            return
        if state.hasTimedOut:
            state.update((end, 1))
            state.setTimeoutTimestamp(forget())
            yield pd.DataFrame({"condition_id": [key[0]], "end_ts": [pd.Timestamp(end, unit="ms")], "status": ["queued"]})
            return
        for pdf in frames:
            end = max([end, *[int(x.value // 1_000_000) for x in pdf["end_ts"]]])
        if done:
            state.update((end, 1))
            state.setTimeoutTimestamp(forget())
        elif end <= state.getCurrentWatermarkMs():
            state.update((end, 1))
            state.setTimeoutTimestamp(forget())
            yield pd.DataFrame({"condition_id": [key[0]], "end_ts": [pd.Timestamp(end, unit="ms")], "status": ["queued"]})
        else:
            state.update((end, 0))
            state.setTimeoutTimestamp(end)

    return (pending.withWatermark("ts", late).select("condition_id", "ts", "end_ts").groupBy("condition_id")
            .applyInPandasWithState(run, _QUEUE_OUT, "end_ms long, done int", "append", GroupStateTimeout.EventTimeTimeout))


def position_change_stream(signatures: DataFrame) -> DataFrame:
    """Snapshot signatures per wallet that differ from the last one seen (wallet, ts, sig)."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            if row.sig != prev:
                out.append((key[0], row.ts, row.sig))
                prev = row.sig
        state.update((prev,))
        yield pd.DataFrame(out, columns=["wallet", "ts", "sig"])

    schema = T.StructType([signatures.schema["wallet"], T.StructField("ts", T.TimestampType()), T.StructField("sig", T.StringType())])
    return signatures.select("wallet", "ts", "sig").groupBy("wallet").applyInPandasWithState(run, schema, "sig string", "append", GroupStateTimeout.NoTimeout)

