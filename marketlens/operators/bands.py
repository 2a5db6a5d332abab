"""Low-price side samples and profit scans over price bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import CHUNK, add_chunk

DAY_S = 86_400


#: Rows whose runs are summed up together for every band.
BLOCK_ROWS = 4096


def price_grid(lo: float = 0.08, hi: float = 0.40, step: float = 0.005) -> list[float]:
    """Grid points by repeated addition, each rounded to 6 places."""
    out, x = [], lo
    while x <= hi + 1e-9:
        out.append(round(x, 6))
        x += step
    return out


def dedupe_slug(markets: DataFrame, order: str = "seq") -> DataFrame:
    """First row per slug, ordered by end (``min_by`` combines before the shuffle)."""
    cols = [x for x in markets.columns if x != "slug"]
    first = markets.groupBy("slug").agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return first.select("slug", "_r.*").orderBy("end_ts", "slug")


def last_price(prices: DataFrame, markets: DataFrame, token: str, out: str, from_s: float, to_s: float) -> DataFrame:
    """Markets with the last price of one token inside [end - from, end - to].

    An equi join on the token, then ``max_by``: each market's interval keeps only its own rows.
    """
    end = F.unix_micros(F.col("end_ts").cast("timestamp"))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    m = markets.select("slug", F.col(token).alias("token_id"), end.alias("_end"))
    j = prices.where(F.col("price").isNotNull()).join(m, "token_id").where(
        (t >= F.col("_end") - int(from_s * 1e6)) & (t <= F.col("_end") - int(to_s * 1e6)))
    return j.groupBy("slug").agg(F.max_by("price", F.struct(t, -F.col("price"))).alias(out))


def low_side_samples(markets: DataFrame, prices: DataFrame, *, from_s: float = 170, to_s: float = 35) -> DataFrame:
    """Per closed market: the cheaper side's normalised price before close and whether it won.

    ``markets`` has (slug, end_ts, token_up, token_down, winner_idx). A tie counts as index 1.
    """
    up = last_price(prices, markets, "token_up", "_u", from_s, to_s)
    dn = last_price(prices, markets, "token_down", "_d", from_s, to_s)
    j = markets.join(up, "slug").join(dn, "slug").withColumn("_s", F.col("_u") + F.col("_d")).where(F.col("_s") > 0)
    pu, pd_ = F.col("_u") / F.col("_s"), F.col("_d") / F.col("_s")
    low = F.when(pu < pd_, 0).otherwise(1)
    return j.select("slug", "end_ts", F.when(low == 0, pu).otherwise(pd_).alias("p_low"), (low == F.col("winner_idx")).alias("low_won"))


def _with_cell(samples: DataFrame, grid: list[float]) -> DataFrame:
    """Adds the number of the half-open grid cell; rows outside the grid are left out.

    Counting the grid points at or below a price is exact where dividing by the step is not.
    """
    cell = F.aggregate(F.array(*[F.lit(g) for g in grid]), F.lit(-1), lambda a, g: a + F.when(F.col("p_low") >= g, 1).otherwise(0))
    return samples.withColumn("_cell", cell).where((F.col("_cell") >= 0) & (F.col("_cell") < len(grid) - 1))


def _bands(df: DataFrame, grid: list[float]) -> DataFrame:
    """Grid bands (i, j, lo, hi), i < j: fixed by the grid, independent of the data."""
    g = F.array(*[F.lit(x) for x in grid])
    spark = df.sparkSession
    return (spark.range(len(grid) - 1).select(F.col("id").cast("int").alias("i"))
            .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(len(grid) - 1))))
            .withColumn("lo", F.element_at(g, F.col("i") + 1)).withColumn("hi", F.element_at(g, F.col("j") + 1)))


def band_totals(samples: DataFrame, grid: list[float], *, stake: float = 0.99) -> DataFrame:
    """n, wins and gross win of every band from cumulative cell sums.

    The data is aggregated once to at most one row per cell; bands are differences of prefix sums, so
    samples are never paired with bands.
    """
    gain = F.when(F.col("low_won"), stake * (1.0 / F.greatest(F.col("p_low"), F.lit(1e-9)) - 1.0)).otherwise(0.0)
    cells = _with_cell(samples, grid).groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("low_won").alias("wins"), F.sum(gain).alias("gp"))
    points = samples.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("pt"))
    # Prefix over the grid points (65 rows by default).
    w = Window.orderBy("pt").rowsBetween(Window.unboundedPreceding, -1)
    pre = points.join(F.broadcast(cells), points["pt"] == cells["_cell"], "left").select(
        "pt", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(x) for x in ("n", "wins", "gp")])
    a = pre.select(F.col("pt").alias("i"), *[F.col(x).alias(f"_{x}") for x in ("n", "wins", "gp")])
    b = pre.withColumnRenamed("pt", "j")
    return _bands(samples, grid).join(F.broadcast(a), "i").join(F.broadcast(b), "j").select(
        "i", "j", "lo", "hi", *[(F.col(x) - F.col(f"_{x}")).alias(x) for x in ("n", "wins", "gp")])


def band_loss_streaks(samples: DataFrame, grid: list[float], *, tie: str = "slug", width_s: float = DAY_S) -> DataFrame:
    """Longest losing run of every band in time order.

    A block of at most BLOCK_ROWS rows is summed up per band by (rows, losses before the first win, losses after
    the last win, longest run), by vector operations over the block for each band; blocks are then merged in
    order like ``loss_streak_rows``.
    """
    k = len(grid)
    d = _with_cell(add_chunk(samples, "end_ts", width_s), grid).select(CHUNK, "_cell", "low_won", F.col("end_ts").alias("_t"), F.col(tie).alias("_tie"))
    i, j = np.triu_indices(k, 1)
    schema = T.StructType([T.StructField(CHUNK, T.LongType()), T.StructField("_sub", T.LongType()), *[T.StructField(x, T.ArrayType(T.LongType())) for x in ("n", "head", "tail", "best", "won")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_tie"])
        cells, wins = pdf["_cell"].to_numpy(), pdf["low_won"].to_numpy(dtype=bool)
        out = []
        for sub, s in enumerate(range(0, len(pdf), BLOCK_ROWS)):
            cell, win = cells[s: s + BLOCK_ROWS], wins[s: s + BLOCK_ROWS]
            stats = np.zeros((5, len(i)), dtype=np.int64)
            for b in range(len(i)):
                own = win[(cell >= i[b]) & (cell < j[b])]
                at = np.flatnonzero(own)
                if len(at):
                    head, tail = at[0], len(own) - 1 - at[-1]
                    stats[:, b] = len(own), head, tail, max(head, tail, np.diff(at).max(initial=1) - 1), 1
                else:
                    stats[:, b] = len(own), len(own), len(own), len(own), 0
            out.append([pdf[CHUNK].iloc[0], sub, *stats.tolist()])
        return pd.DataFrame(out, columns=schema.names)

    per = d.groupBy(CHUNK).applyInPandas(run, schema)
    bands = per.select(CHUNK, "_sub", F.posexplode(F.arrays_zip("n", "head", "tail", "best", "won")).alias("b", "x")).select(CHUNK, "_sub", "b", "x.*").where("n > 0")
    w = Window.partitionBy("b").orderBy(CHUNK, "_sub").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_n0", F.coalesce(F.sum("n").over(w), F.lit(0)))
    bands = bands.withColumn("_w0", F.coalesce(F.max(F.when(F.col("won") == 1, F.col("_n0") + F.col("n") - F.col("tail"))).over(w), F.lit(0)))
    out = bands.groupBy("b").agg(F.max(F.greatest("best", F.when(F.col("head") > 0, F.col("_n0") - F.col("_w0") + F.col("head")).otherwise(0))).alias("max_loss_streak"))
    pairs = F.array(*[F.lit(int(x) * k + int(y)) for x, y in zip(i, j)])
    code = F.element_at(pairs, F.col("b").cast("int") + 1)
    return out.select(F.floor(code / k).cast("int").alias("i"), (code % k).alias("j"), "max_loss_streak")


def band_profit_scan(samples: DataFrame, *, grid: list[float] | None = None, stake: float = 0.99, start_bank: float = 30.0, min_n: int = 20,
                     tie: str = "slug", width_s: float = DAY_S) -> DataFrame:
    """Every band with at least ``min_n`` samples and a finite profit factor."""
    grid = grid or price_grid()
    t = band_totals(samples, grid, stake=stake).withColumn("losses", F.col("n") - F.col("wins")).where((F.col("n") >= min_n) & (F.col("losses") > 0))
    s = band_loss_streaks(samples, grid, tie=tie, width_s=width_s)
    pnl = F.col("gp") - F.col("losses") * stake
    return t.join(s, ["i", "j"]).select(
        "lo", "hi", "n", "wins", (F.col("wins") / F.col("n")).alias("wr"), (F.col("gp") / (F.col("losses") * stake)).alias("pf"),
        (pnl + start_bank).alias("bank_final"), pnl.alias("pnl"), "max_loss_streak")


def best_bands(scan: DataFrame, k: int = 20) -> DataFrame:
    return scan.orderBy(F.desc("pf"), F.desc("n"), F.asc("lo"), F.asc("hi")).limit(k)
