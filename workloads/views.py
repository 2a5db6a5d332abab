"""Market views over the driver tables: one Spark builder and one SQL text per view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
SIX_HOURS = 6 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


# ---------------------------------------------------------------- activity
def activity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("wallet"), (F.col("event_id") % 97).alias("condition_id"),
        F.when(F.col("event_type") == "purchase", "TRADE").when(F.col("event_type") == "click", "BUY")
         .when(F.col("event_type") == "signup", "REDEEM").otherwise("OTHER").alias("type"),
        F.when(F.col("event_type") == "purchase", "BUY").alias("side"),
        F.when(F.col("event_id") % 3 == 0, "Up").when(F.col("event_id") % 3 == 1, "Down").otherwise("").alias("outcome"),
        F.col("value").alias("usdc_size"), F.col("value").alias("size"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"))


ACTIVITY = """activity AS (
  SELECT user_id AS wallet, event_id % 97 AS condition_id,
    CASE event_type WHEN 'purchase' THEN 'TRADE' WHEN 'click' THEN 'BUY' WHEN 'signup' THEN 'REDEEM' ELSE 'OTHER' END AS type,
    CASE WHEN event_type = 'purchase' THEN 'BUY' END AS side,
    CASE event_id % 3 WHEN 0 THEN 'Up' WHEN 1 THEN 'Down' ELSE '' END AS outcome,
    value AS usdc_size, value AS size, epoch_us(ts) AS t, event_id
  FROM events)"""


# ---------------------------------------------------------------- ticks / bars / rounds
def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.lit(100.0) + F.col("value")).alias("price"), "user_id")


TICKS = """ticks AS (
  SELECT event_type AS asset, epoch_us(ts) AS t, 100.0 + value AS price, user_id FROM events)"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    open_us = F.expr(f"unix_micros(ts) div {HOUR} * {HOUR}")
    return (t.withColumn("_o", open_us).groupBy("asset", "_o")
            .agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
                 F.max_by("price", "ts").alias("c"), F.count("*").cast("double").alias("v"),
                 F.sum(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0)).alias("taker_v"))
            .select("asset", F.timestamp_micros("_o").alias("ts"), "o", "h", "l", "c", "v", "taker_v"))


BARS = f"""bars AS (
  SELECT asset, t // {HOUR} * {HOUR} AS t, arg_min(price, t) AS o, max(price) AS h, min(price) AS l,
    arg_max(price, t) AS c, count(*)::DOUBLE AS v,
    sum(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS taker_v
  FROM ticks GROUP BY 1, 2)"""


def round_slots(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (asset, 6-hour slot) of the ticks."""
    t = ticks(spark, d)
    return (t.select("asset", F.expr(f"unix_micros(ts) div {SIX_HOURS} * {SIX_HOURS}").alias("start_us")).distinct()
            .select("asset", F.timestamp_micros("start_us").alias("start_ts"),
                    F.timestamp_micros(F.col("start_us") + SIX_HOURS).alias("end_ts")))


SLOTS = f"""slots AS (SELECT DISTINCT asset, t // {SIX_HOURS} * {SIX_HOURS} AS start_t FROM ticks)"""

ROUNDS = f"""rounds AS (
  SELECT s.asset, s.start_t, s.start_t + {SIX_HOURS} AS end_t,
    (SELECT arg_min(price, t) FROM ticks k WHERE k.asset = s.asset AND k.t >= s.start_t) AS open,
    (SELECT arg_min(price, t) FROM ticks k WHERE k.asset = s.asset AND k.t >= s.start_t + {SIX_HOURS}) AS close
  FROM slots s)"""


def rounds(spark: SparkSession, d: str) -> DataFrame:
    from marketlens.operators.asof import asof_forward
    s = round_slots(spark, d)
    ends = s.select("*", F.posexplode(F.array("start_ts", "end_ts")).alias("_i", "_at"))
    got = asof_forward(ends, ticks(spark, d), ["asset"], left_ts="_at", right_ts="ts", take={"_p": "price"})
    return got.groupBy("asset", "start_ts", "end_ts").agg(
        F.max(F.when(F.col("_i") == 0, F.col("_p"))).alias("open"), F.max(F.when(F.col("_i") == 1, F.col("_p"))).alias("close"))


# ---------------------------------------------------------------- trades
def trades(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_partkey").alias("condition_id"), F.col("l_suppkey").alias("wallet"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.when(F.col("l_returnflag") == "A", "Up").when(F.col("l_returnflag") == "R", "Down").otherwise("").alias("outcome"),
        F.round(F.col("l_discount") * 9 + 0.05, 4).alias("price"), F.col("l_quantity").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber")


TRADES = """trades AS (
  SELECT l_partkey AS condition_id, l_suppkey AS wallet, CASE l_linestatus WHEN 'O' THEN 'BUY' ELSE 'SELL' END AS side,
    CASE l_returnflag WHEN 'A' THEN 'Up' WHEN 'R' THEN 'Down' ELSE '' END AS outcome,
    round(l_discount * 9 + 0.05, 4) AS price, l_quantity AS size, epoch_us(l_shipdate) AS t, l_orderkey, l_linenumber
  FROM lineitem)"""


# ---------------------------------------------------------------- positions
def positions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("condition_id"), F.col("o_custkey").alias("wallet"),
        F.when(F.col("o_orderstatus") == "O", "Up").when(F.col("o_orderstatus") == "P", "Down").otherwise("").alias("outcome"),
        (F.col("o_totalprice") / 1e4).alias("current_value"),
        F.left("o_orderpriority", F.lit(1)).isin("1", "2").alias("redeemable"),
        F.col("o_orderdate").cast("timestamp").alias("snapshot_ts"))


POSITIONS = """positions AS (
  SELECT o_orderkey AS condition_id, o_custkey AS wallet,
    CASE o_orderstatus WHEN 'O' THEN 'Up' WHEN 'P' THEN 'Down' ELSE '' END AS outcome,
    o_totalprice / 1e4 AS current_value, left(o_orderpriority, 1) IN ('1', '2') AS redeemable,
    epoch_us(o_orderdate) AS t
  FROM orders)"""


# ---------------------------------------------------------------- entries / resolves
def entries(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("condition_id"),
        F.when(F.col("o_custkey") % 19 != 0, F.col("o_custkey") % 18).alias("score"),
        F.when(F.col("o_orderstatus") == "O", "PM").when(F.col("o_orderstatus") == "P", "CL-exact")
         .otherwise("CL-fallback").alias("open_price_source"),
        F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 120).cast("double")).alias("chainlink_age_s"),
        F.col("o_orderdate").cast("timestamp").alias("ts"))


ENTRIES = """entries AS (
  SELECT o_orderkey AS condition_id, CASE WHEN o_custkey % 19 <> 0 THEN o_custkey % 18 END AS score,
    CASE o_orderstatus WHEN 'O' THEN 'PM' WHEN 'P' THEN 'CL-exact' ELSE 'CL-fallback' END AS open_price_source,
    CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 120)::DOUBLE END AS chainlink_age_s, epoch_us(o_orderdate) AS t
  FROM orders)"""


def resolves(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    won = F.col("l_returnflag") != "R"
    size = F.round(F.col("l_quantity") / 10, 2)
    entry = F.round(F.col("l_discount") * 6 + 0.2, 4)
    return x.select(
        F.col("l_orderkey").alias("condition_id"), F.when(won, "WIN").otherwise("LOSS").alias("result"), won.alias("won"),
        F.when(won, F.round(size * (1 / entry - 1), 4)).otherwise(-size).alias("pnl"), size.alias("size"),
        entry.alias("entry"),
        F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down").alias("side"),
        F.element_at(F.array(*[F.lit(a) for a in ("BTC", "ETH", "SOL", "XRP")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("asset"),
        F.when(F.col("l_linenumber") % 2 == 0, 5).otherwise(15).cast("bigint").alias("duration"),
        (F.col("l_partkey") % 18).alias("score"), F.col("l_suppkey").alias("wallet"),
        F.round((F.col("l_tax") - 0.04) * 1e4, 2).alias("slip_bps"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey")


RESOLVES = """resolves AS (
  SELECT l_orderkey AS condition_id, CASE WHEN l_returnflag <> 'R' THEN 'WIN' ELSE 'LOSS' END AS result,
    l_returnflag <> 'R' AS won,
    CASE WHEN l_returnflag <> 'R'
      THEN round(round(l_quantity / 10, 2) * (1 / round(l_discount * 6 + 0.2, 4) - 1), 4)
      ELSE -round(l_quantity / 10, 2) END AS pnl,
    round(l_quantity / 10, 2) AS size, round(l_discount * 6 + 0.2, 4) AS entry,
    CASE l_linestatus WHEN 'O' THEN 'Up' ELSE 'Down' END AS side,
    list_extract(['BTC', 'ETH', 'SOL', 'XRP'], l_suppkey % 4 + 1) AS asset,
    CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END::BIGINT AS duration, l_partkey % 18 AS score, l_suppkey AS wallet,
    round((l_tax - 0.04) * 1e4, 2) AS slip_bps, epoch_us(l_shipdate) AS t, l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""

# Total order of the resolves.
RES_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]
RES_ORDER_SQL = "t, l_orderkey, l_linenumber, l_partkey"


# ---------------------------------------------------------------- books
def books(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    size = lambda x: F.abs(x.cast("double"))
    return e.select(F.col("vec_id").alias("book_id"),
                    F.transform(F.slice("embedding", 1, 20), size).alias("bids"),
                    F.transform(F.slice("embedding", 21, 20), size).alias("asks"))


BOOKS = """books AS (
  SELECT vec_id AS book_id, list_transform(embedding[1:20], lambda x: abs(x::DOUBLE)) AS bids,
    list_transform(embedding[21:40], lambda x: abs(x::DOUBLE)) AS asks
  FROM embeddings)"""


# ---------------------------------------------------------------- signals
def signals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    entry = F.round(F.col("l_discount") * 9 + 0.05, 4)
    prob = F.round(0.05 + F.least(F.lit(0.9), (F.col("l_quantity") / 50.0) * 0.9), 4)
    s = x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.element_at(F.array(*[F.lit(a) for a in ("BTC", "ETH", "SOL", "XRP")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("asset"),
        F.when(F.col("l_linenumber") % 2 == 0, 5).otherwise(15).cast("bigint").alias("duration"),
        F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down").alias("side"),
        (F.col("l_partkey") % 18).alias("score"), entry.alias("entry"), prob.alias("true_prob"),
        F.lit(100.0).alias("open_price"), F.round(100.0 + (F.col("l_tax") - 0.04) * 10, 4).alias("current"),
        F.round(F.col("l_extendedprice") % 15, 2).alias("mins_left"),
        F.round(F.col("l_extendedprice") % 4000, 2).alias("quote_age_ms"),
        F.round(F.col("l_extendedprice") % 2900, 2).alias("signal_latency_ms"),
        (F.col("l_returnflag") != "N").alias("cl_agree"), (F.col("l_partkey") % 5).alias("tf_votes"),
        (F.col("l_orderkey") % 10 == 0).alias("is_addon"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return s.withColumns({
        "payout_mult": 1 / F.col("entry"), "execution_ev": F.col("true_prob") / F.col("entry") - 1 - 0.0156,
        "edge": F.col("true_prob") - F.col("entry"),
        "pct_remaining": F.least(F.lit(1.0), F.col("mins_left") / F.col("duration"))})


SIGNALS = """signals AS (
  SELECT *, 1 / entry AS payout_mult, true_prob / entry - 1 - 0.0156 AS execution_ev, true_prob - entry AS edge,
    least(1.0, mins_left / duration) AS pct_remaining
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    list_extract(['BTC', 'ETH', 'SOL', 'XRP'], l_suppkey % 4 + 1) AS asset,
    CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 15 END::BIGINT AS duration,
    CASE l_linestatus WHEN 'O' THEN 'Up' ELSE 'Down' END AS side, l_partkey % 18 AS score,
    round(l_discount * 9 + 0.05, 4) AS entry, round(0.05 + least(0.9, (l_quantity / 50.0) * 0.9), 4) AS true_prob,
    100.0::DOUBLE AS open_price, round(100.0 + (l_tax - 0.04) * 10, 4)::DOUBLE AS "current",
    round(l_extendedprice % 15, 2) AS mins_left, round(l_extendedprice % 4000, 2) AS quote_age_ms,
    round(l_extendedprice % 2900, 2) AS signal_latency_ms, l_returnflag <> 'N' AS cl_agree,
    l_partkey % 5 AS tf_votes, l_orderkey % 10 = 0 AS is_addon, epoch_us(l_shipdate) AS t
  FROM lineitem))"""


_CTES = {"activity": ACTIVITY, "ticks": TICKS, "bars": BARS, "slots": SLOTS, "rounds": ROUNDS, "trades": TRADES,
         "positions": POSITIONS, "entries": ENTRIES, "resolves": RESOLVES, "books": BOOKS, "signals": SIGNALS}
_NEEDS = {"bars": ("ticks",), "slots": ("ticks",), "rounds": ("ticks", "slots")}


def with_views(names: str, *ctes: str) -> str:
    """``WITH`` clause of the named views, what they need, and further CTE texts."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in done:
            done.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join([_CTES[n] for n in done] + list(ctes)) + "\n"
