"""Exponential averages and the constant-velocity filter, at any key size.

An exponential average forgets: a value 40 time constants old weighs e^-40, below double precision.
So a chunk with 40 constants of earlier rows copied in gives the same doubles as one long scan, and
inside a chunk the average is a weighted window sum.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import ColumnOrName, c, div_or, epoch_us
from ..functions.prob import norm_cdf
from .ordered import BLOCK, CHUNK, INDEX, OWN, dense_index, own_rows, row_halo, time_halo

# Time constants of the tick averages, seconds.
TAUS = (5, 15, 30, 60, 120)
FORGET = 40.0  # e^-40 = 4e-18
MAX_EXP = 600.0  # largest exponent formed inside a chunk
SECONDS_PER_YEAR = 252 * 24 * 3600
DAY_S = 86_400


def time_ema(ticks: DataFrame, tau_s: float, *, keys: Sequence[str] = ("asset",), ts: str = "ts", value: str = "price",
             tie: Sequence[str] = (), name: str = "ema") -> DataFrame:
    """x += (1 - exp(-dt / tau)) * (value - x), seeded with the first value of each key."""
    width, halo = (MAX_EXP - FORGET) * tau_s / 2, FORGET * tau_s
    d = time_halo(ticks, ts, width, halo).withColumn("_t", epoch_us(ts))
    w = Window.partitionBy(*keys, CHUNK).orderBy("_t", *tie)
    dt = (F.col("_t") - F.lag("_t").over(w)) / 1e6
    alpha = F.when(dt.isNull(), F.lit(1.0)).otherwise(1.0 - F.exp(-dt / tau_s))
    u = ((F.col("_t") - F.col(CHUNK) * int(width * 1e6)) / 1e6 + halo) / tau_s
    d = d.withColumns({"_u": u, "_av": alpha * F.col(value)})
    total = F.sum(F.col("_av") * F.exp("_u")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, total * F.exp(-F.col("_u"))).where(OWN).drop("_t", "_u", "_av", CHUNK, OWN)


def row_emas(rows: DataFrame, emas: Mapping[str, tuple[float, ColumnOrName, float | None]], *, keys: Sequence[str], order: Sequence[str],
             ts: str = "ts", width_s: float | None = None) -> DataFrame:
    """Any number of averages, name -> (alpha, value, seed), over one order: rows are indexed once and move once for all of them.

    Each is x = (1 - alpha) * x + alpha * value per row, from its seed or (None) from the first value.
    """
    lams = {n: -math.log1p(-alpha) for n, (alpha, _, _) in emas.items()}
    halo = max(math.ceil(FORGET / lam) for lam in lams.values())
    block = min(int(MAX_EXP / lam) - halo for lam in lams.values())
    if block < halo:
        raise ValueError("averages of too different length; compute them apart")
    values = [c(v).cast("double").alias(f"_v_{n}") for n, (_, v, _) in emas.items()]
    d = row_halo(dense_index(rows.select("*", *values), keys, order, ts=ts, width_s=width_s), halo, block)
    w = Window.partitionBy(*keys, BLOCK).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)

    def average(n: str, alpha: float, seed: float | None) -> Column:
        lam, v = lams[n], F.col(f"_v_{n}")
        u = (F.col(INDEX) - F.col(BLOCK) * block + halo) * lam
        first = F.lit(float(seed)) if seed is not None else F.first(v).over(w)
        return F.sum(v * alpha * F.exp(u)).over(w) * F.exp(-u) + first * F.exp(-(F.col(INDEX) + 1) * lam)

    return own_rows(d.withColumns({n: average(n, alpha, seed) for n, (alpha, _, seed) in emas.items()})).drop(*[f"_v_{n}" for n in emas])


def row_ema(rows: DataFrame, alpha: float, *, keys: Sequence[str], order: Sequence[str], value: ColumnOrName, seed: float | None = None,
            ts: str = "ts", width_s: float | None = None, name: str = "ema") -> DataFrame:
    """x = (1 - alpha) * x + alpha * value per row, from ``seed`` or from the first value."""
    return row_emas(rows, {name: (alpha, value, seed)}, keys=keys, order=order, ts=ts, width_s=width_s)


def latency_ema(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str = "latency_ms", alpha: float = 0.2,
                **kw) -> DataFrame:
    return row_ema(rows, alpha, keys=keys, order=order, value=value, **kw)


def calibration_emas(outcomes: DataFrame, *, keys: Sequence[str], order: Sequence[str], prob: str = "p", won: str = "won", **kw
                     ) -> DataFrame:
    """Squared-error average (.96 / .04 from 0.25) and hit reliability (.97 / .03 from 1).

    Reliability mixes 0.6 and 1.4 from a start of 1, so it never leaves [0.6, 1.4] and the outer
    clamp to [0.35, 1.65] cannot bind.
    """
    y = F.col(won).cast("double")
    hit = ((F.col(prob) >= 0.5) == F.col(won)).cast("double")
    return row_emas(outcomes, {"cal_err_ema": (0.04, F.pow(F.col(prob) - y, F.lit(2.0)), 0.25), "reliability": (0.03, 0.60 + 0.80 * hit, 1.0)},
                    keys=keys, order=order, **kw)


def nearest_tau(seconds: float, taus: Sequence[float] = TAUS) -> float:
    """Cached time constant used for a momentum horizon (180 s resolves to 120)."""
    return min(taus, key=lambda t: abs(t - seconds))


def momentum_prob(price: ColumnOrName, ema: ColumnOrName, vol: ColumnOrName | float, tau_s: float) -> Column:
    """P(Up) from the distance of the price to its average in volatility units."""
    p, e = c(price), c(ema)
    good = (F.coalesce(p, F.lit(0.0)) != 0) & (F.coalesce(e, F.lit(0.0)) != 0) & (c(vol) > 0)
    z = F.try_divide(p - e, e) / (c(vol) * math.sqrt(tau_s / SECONDS_PER_YEAR))
    return F.when(good, norm_cdf(F.when(good, z))).otherwise(F.lit(0.5))


def velocity_prob(pos: ColumnOrName, vel: ColumnOrName, vol: ColumnOrName | float) -> Column:
    """P(Up) from the filtered velocity."""
    per_sec = F.greatest(c(vol) * c(pos) / math.sqrt(SECONDS_PER_YEAR), F.lit(1e-10))
    return F.when(F.coalesce(c(pos), F.lit(0.0)) == 0, F.lit(0.5)).otherwise(norm_cdf(c(vel) / per_sec * 10.0))


FILTER_START = (0.0, 0.0, 1.0, 0.0, 0.01)


def filter_step(state: tuple, dt: float, price: float, vol: float) -> tuple:
    """One step of the constant-velocity filter: (position, velocity, three covariance terms). Noise scales with
    volatility and price; the cross term enters the position variance once."""
    pos, vel, p00, p01, p11 = state
    q = (vol * price / math.sqrt(SECONDS_PER_YEAR)) ** 2
    r = (vol * price * 0.001) ** 2
    pos += vel * dt
    p00 += dt * p01 + dt * dt * p11 + q
    p01 += dt * p11
    p11 += q * 0.01
    gain_p, gain_v, miss = p00 / (p00 + r), p01 / (p00 + r), price - pos
    return pos + gain_p * miss, vel + gain_v * miss, (1.0 - gain_p) * p00, (1.0 - gain_p) * p01, p11 - gain_v * p01


def _filter_rows(t: list[float], price: list[float], vol: list[float]) -> tuple[list[float], list[float]]:
    """The filter over one block; the first row sets the position."""
    pos, vel, state = [], [], (price[0], *FILTER_START[1:]) if price else FILTER_START
    for i, z in enumerate(price):
        if i:
            state = filter_step(state, t[i] - t[i - 1], z, vol[i])
        pos.append(state[0])
        vel.append(state[1])
    return pos, vel


def kalman_velocity(ticks: DataFrame, *, keys: Sequence[str] = ("asset",), ts: str = "ts", price: str = "price", vol: str = "vol",
                    tie: Sequence[str] = (), width_s: float | None = None, halo: int = 512, block: int = 65_536) -> DataFrame:
    """Adds filtered ``pos`` and ``vel``.

    The covariance recursion is no weighted sum, so each index block runs in a pandas task, started
    ``halo`` rows early; by then the start values are forgotten (tested against one long scan).
    """
    d = row_halo(dense_index(ticks, keys, [ts, *tie], ts=ts, width_s=width_s), halo, block).withColumn("_t", epoch_us(ts) / 1e6)
    schema = T.StructType([*[f for f in d.schema.fields], T.StructField("pos", T.DoubleType()), T.StructField("vel", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        pos, vel = _filter_rows(pdf["_t"].tolist(), pdf[price].tolist(), pdf[vol].tolist())
        return pdf.assign(pos=pos, vel=vel)[lambda x: x[OWN]]

    return own_rows(d.groupBy(*keys, BLOCK).applyInPandas(run, schema)).drop("_t")


def ema_cross(short: ColumnOrName, long: ColumnOrName) -> Column:
    return div_or(short, long, None) - 1.0
