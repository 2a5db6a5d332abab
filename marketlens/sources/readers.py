"""Readers: landed raw files -> silver DataFrames. Every schema is fixed; bad rows are dropped or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import normalize as N
from ..functions.base import safe_double
from ..functions.prob import best_quotes

# Terminal colour codes and the result line of the text log.
ANSI = r"\x1B\[[0-9;]*m"
RESULT_LINE = r"\[(WIN|LOSS)\].*\|\s*\$([+-]?\d+(?:\.\d+)?)\s*\|\s*Bank"


def _json(spark: SparkSession, path: str, schema: str, *, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)


def activity_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        N.norm_wallet("proxyWallet").alias("wallet"), F.col("conditionId").alias("condition_id"), "type", "side", "outcome",
        F.col("usdcSize").alias("usdc_size"), "size", N.norm_epoch("timestamp").alias("ts"), "title",
        F.coalesce(F.nullif("id", F.lit("")), F.nullif("transactionHash", F.lit("")),
                   F.sha2(F.to_json(F.struct(*sorted(raw.columns))), 256)).alias("event_id"))


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Wallet events over all landed pages, one row per id, else transaction, else hash of the whole row."""
    return activity_columns(_json(spark, path, S.ACTIVITY)).dropDuplicates(["event_id"])


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    r = _json(spark, path, S.TRADES)
    return r.select(F.col("conditionId").alias("condition_id"), N.norm_wallet("proxyWallet").alias("wallet"), F.upper("side").alias("side"),
                    "outcome", "price", "size", N.norm_epoch("timestamp").alias("ts"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Position snapshots; ``snapshot_ts`` comes from the directory partition."""
    r = _json(spark, path, S.POSITIONS + ", snapshot_ts timestamp")
    return r.select("snapshot_ts", F.col("conditionId").alias("condition_id"), "outcome", "title", F.col("currentValue").alias("current_value"), "size", "redeemable")


def _texts(col: str) -> Column:
    return F.from_json(col, "array<string>")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Nested event -> markets, with string-encoded arrays. Markets without two outcomes are dropped."""
    m = _json(spark, path, S.EVENTS).select(F.col("seriesSlug").alias("_series"), F.col("startTime").alias("_start"), F.explode("markets").alias("m"))
    prices = F.transform(_texts("m.outcomePrices"), lambda x: x.try_cast("double"))
    r = m.select(
        F.col("m.conditionId").alias("condition_id"), F.col("m.slug").alias("slug"), F.col("m.question").alias("question"),
        F.coalesce("m.seriesSlug", "_series").alias("series"), N.parse_iso(F.coalesce("m.eventStartTime", "_start")).alias("start_ts"),
        N.parse_iso("m.endDate").alias("end_ts"), _texts("m.outcomes").alias("outcomes"), prices.alias("outcome_prices"),
        _texts("m.clobTokenIds").alias("tokens"), F.col("m.closed").alias("closed"))
    asset, minutes = N.classify_family("series", "question")
    return r.where((F.size("outcomes") == 2) & (F.size("outcome_prices") == 2) & ~F.exists("outcome_prices", lambda x: x.isNull())).withColumns(
        {"asset": asset, "duration": minutes})


def resolved_rounds(rounds: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Closed rounds with a clear winner by final price."""
    p, o = F.col("outcome_prices"), F.col("outcomes")
    return rounds.withColumn("winner", N.winner_by_price(p[0], p[1], o[0], o[1], threshold)).where(F.col("winner").isNotNull())


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``{asset, interval, rows: [[open-ms, o, h, l, c, v, ., ., ., taker-v, ...]]}``; a repeated bar keeps the later line."""
    r = spark.read.schema("asset string, interval string, seq long, rows array<array<string>>").option("mode", "DROPMALFORMED").json(path)
    k = r.select("asset", "interval", F.coalesce("seq", F.lit(0)).alias("_seq"), F.posexplode("rows").alias("_pos", "k"))
    d = lambda i: F.try_element_at("k", F.lit(i + 1)).try_cast("double")
    b = k.select("asset", "interval", F.struct("_seq", "_pos").alias("_at"), F.timestamp_millis(d(0).cast("bigint")).alias("ts"),
                 F.struct(d(1).alias("o"), d(2).alias("h"), d(3).alias("l"), d(4).alias("c"), d(5).alias("v"), d(9).alias("taker_v")).alias("b"))
    return b.where(F.col("ts").isNotNull() & F.col("b.c").isNotNull()).groupBy("asset", "interval", "ts").agg(
        F.max_by("b", "_at").alias("b")).select("asset", "interval", "ts", "b.*")


def read_token_prices(spark: SparkSession, path: str) -> DataFrame:
    h = _json(spark, path, S.TOKEN_PRICES).select("token_id", F.explode("history").alias("h"))
    return h.where(F.col("h.t").isNotNull() & F.col("h.p").isNotNull()).select("token_id", N.norm_epoch("h.t").alias("ts"), F.col("h.p").alias("price"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Event lines; unreadable ones are skipped. ``present`` lists the keys a line held. ``seq`` orders lines by file path,
    then by place: (path, start of the split, row within the split), whatever files and splits share a task."""
    row = (F.monotonically_increasing_id() % (1 << 33)).alias("row")  # rows of a task come in the order of its splits
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row).alias("seq"))
    keys = F.json_object_keys("value")
    return (raw.withColumn("present", keys).where(F.col("present").isNotNull())
            .withColumn("r", F.from_json("value", S.METRICS)).select("seq", "present", "r.*").where(F.col("event").isNotNull()))


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """WIN / LOSS lines of a coloured text log with their profit."""
    t = spark.read.text(path).select(F.regexp_replace("value", ANSI, "").alias("v"))
    return t.where(F.regexp_like("v", F.lit(RESULT_LINE))).select(
        F.regexp_extract("v", RESULT_LINE, 1).alias("result"), safe_double(F.regexp_extract("v", RESULT_LINE, 2)).alias("pnl"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Settled ledger rows; an unreadable profit counts as 0."""
    r = spark.read.schema(S.LEDGER).option("header", True).csv(path)
    return r.where(F.upper("result").isin("WIN", "LOSS")).withColumns(
        {"result": F.upper("result"), "pnl": safe_double("pnl"), **{x: safe_double(x, None) for x in ("bet_usdc", "entry", "bankroll")}})


def read_flow_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(leaders with a positive score, side flow per market) of one snapshot document."""
    d = _json(spark, path, S.FLOW_DOC, multi_line=True)
    lead = d.select(F.explode("leaders").alias("l")).select("l.*").where(F.col("score") > 0).withColumn("wallet", N.norm_wallet("wallet"))
    flow = d.select("generated_at", F.explode("market_side_flow").alias("condition_id", "f")).select(
        "condition_id", F.col("f.Up").alias("up"), F.col("f.Down").alias("down"), F.col("f.n").alias("n"), F.timestamp_seconds("generated_at").alias("ts"))
    return lead, flow


def read_pending(spark: SparkSession, path: str, now_s: float, *, grace_s: float = 300) -> DataFrame:
    """Map market -> [market, trade]; rows that ended more than five minutes ago are dropped."""
    t = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("condition_id", "pair"))
    r = t.select("condition_id", F.from_json(F.col("pair")[0], S.PENDING_MARKET).alias("m"), F.from_json(F.col("pair")[1], S.PENDING_TRADE).alias("t"))
    end = F.coalesce("m.end_ts", "t.end_ts", F.lit(0.0))
    return r.where((end <= 0) | (end >= now_s - grace_s)).select(
        "condition_id", F.col("m.question").alias("question"), F.coalesce("t.asset", "m.asset").alias("asset"), F.coalesce("t.duration", "m.duration").alias("duration"),
        F.col("m.start_ts").alias("start_s"), end.alias("end_s"), F.col("t.side").alias("side"), F.col("t.size").alias("size"), F.col("t.entry").alias("entry"),
        F.col("t.placed_ts").alias("placed_s"), F.col("t.order_id").alias("order_id"), F.col("t.token_id").alias("token_id"))


def read_probe_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, S.PROBES).where(F.col("latency_ms").isNotNull())


# ---------------------------------------------------------------- message parsing (batch and stream)
def parse_ticks(raw: DataFrame, value: str = "value") -> DataFrame:
    """Price messages -> (asset, ts, price); other topics, unknown symbols and zero prices are dropped."""
    m = raw.select(F.from_json(F.col(value).cast("string"), S.TICK_MSG).alias("m")).where(F.col("m.topic") == "crypto_prices")
    return m.select(N.symbol_asset("m.payload.symbol").alias("asset"), N.norm_epoch("m.ts").alias("ts"), F.col("m.payload.value").alias("price")).where(
        F.col("asset").isNotNull() & (F.coalesce("price", F.lit(0.0)) != 0))


def parse_books(raw: DataFrame, value: str = "value") -> DataFrame:
    """Depth messages -> all typed levels, best first, with the best quotes."""
    lv = lambda c: F.transform(c, lambda x: F.struct(x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("size")))
    m = raw.select(F.from_json(F.col(value).cast("string"), S.BOOK_MSG).alias("m")).select(
        "m.asset", N.norm_epoch("m.ts").alias("ts"), F.coalesce("m.tick", F.lit(0.01)).alias("tick"),
        F.array_sort(lv("m.bids"), lambda a, b: F.when(a["price"] > b["price"], -1).when(a["price"] < b["price"], 1).otherwise(0)).alias("bids"),
        F.array_sort(lv("m.asks"), lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).otherwise(0)).alias("asks"))
    bid, ask = best_quotes("bids", "asks")
    return m.withColumns({"best_bid": bid, "best_ask": ask}).where(F.col("asset").isNotNull())


def parse_perp(raw: DataFrame, value: str = "value") -> DataFrame:
    m = raw.select(F.from_json(F.col(value).cast("string"), S.PERP_MSG).alias("m"))
    return m.select("m.asset", N.norm_epoch("m.ts").alias("ts"), *[safe_double(f"m.{x}").alias(x) for x in ("mark", "index", "funding")]).where(F.col("asset").isNotNull())


def parse_oracle(raw: DataFrame, value: str = "value", *, fresh_s: float | None = 60, now: str | None = None) -> DataFrame:
    """Oracle answers scaled by 1e8; with a ``now`` column only answers younger than ``fresh_s`` stay."""
    keep = [now] if now else []
    m = raw.select(F.from_json(F.col(value).cast("string"), S.ORACLE_MSG).alias("m"), *keep)
    r = m.select("m.asset", "m.round_id", (F.col("m.answer").cast("double") / 1e8).alias("price"), N.norm_epoch("m.updated_at").alias("updated_at"), *keep).where(
        F.col("asset").isNotNull() & (F.col("price") > 0))
    if now and fresh_s is not None:
        r = r.where(F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros("updated_at") < int(fresh_s * 1e6)).drop(now)
    return r
