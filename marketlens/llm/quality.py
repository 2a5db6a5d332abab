"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, id_remainder, with_text_column

#: Number of random features of the Gaussian kernel, its inverse width, ridge weight, calibration bins per unit of raw score.
FEATURES, GAMMA, RIDGE, BINS = 128, 0.12, 1e-3, 512
ACCEPT = 0.3

_classes = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _classes[_b] = [_b < 128 and _c.isupper(), _b < 128 and _c.islower(), _b < 128 and _c.isdigit(), _b in (32, 9, 13), _b == 10, 32 < _b < 127 and not _c.isalnum()]
STATS = 20


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    upper, lower, digit, space, newline, punct = (hist @ _classes) / n
    words = text.split()
    k = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(map(operator.eq, words, words[1:])) / k
    lines = text.split("\n")
    p = hist[hist > 0] / n
    marks = hist[[124, 35, 36, 37, 38, 42, 33]] / k  # | # $ % & * ! per word
    return [np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(text) / k), upper / max(1e-9, upper + lower), digit, space, newline * 10, punct, 1 - (upper + lower + digit + space + newline + punct),
            distinct / k, np.log1p(distinct) / np.log1p(k), repeats, -(p * np.log(p)).sum(), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), (hist[46] + hist[63]) / k,
            min(2.0, marks[0]), min(2.0, marks[1:6].sum()), min(2.0, marks[6]), (hist[60] + hist[62] + hist[123] + hist[125]) / k]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``stats`` (array of doubles)."""
    def make():
        return lambda texts: {"stats": [statistics(t) for t in texts]}

    return with_text_column(df, text, make, "stats array<double>")


class QualityModel:
    """Standardisation, random directions, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None, seed: int = 11):
        self.mean, self.scale, self.weights = mean, scale, weights
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((STATS, FEATURES)) * np.sqrt(2 * GAMMA)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.directions + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if self.weights is None:
            return np.interp(raw, self.knots, self.values)
        order = 1 / (1 + np.exp(-4 * (raw - 0.5)))  # keeps the order inside flat parts of the curve
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 * order, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to y (weights w) in the order of x."""
    blocks: list[list[float]] = []
    for yi, wi in zip(y[np.argsort(x)], w[np.argsort(x)]):
        blocks.append([yi, wi, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit(rows: DataFrame) -> QualityModel:
    """Fit on ``rows`` (stats, y in [0, 1]), all of them. Every partition sums its part of the normal equations; the
    sums that reach the driver have a size set by FEATURES and BINS alone. No rows: every score is 0.5."""
    bounded_batches(rows.sparkSession)
    rows = checkpointed(rows.select("stats", "y"))
    got = rows.agg(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got["n"]:
        return QualityModel(np.zeros(STATS), np.ones(STATS))
    model = QualityModel(np.array([got[f"m{i}"] for i in range(STATS)]), np.array([max(got[f"s{i}"], 1e-3) for i in range(STATS)]))
    d = FEATURES + 1
    i, j = np.triu_indices(d)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for f in frames:
            z = model.expand(np.array(f["stats"].tolist()).reshape(len(f), STATS))
            a += z.T @ z
            b += z.T @ f["y"].to_numpy()
        if a[-1, -1]:
            yield pd.DataFrame({"i": np.append(i, np.arange(d)), "j": np.append(j, np.full(d, d)), "v": np.append(a[i, j], b)})

    parts = rows.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    a, b = np.zeros((d, d)), np.zeros(d)
    for r in parts:
        if r["j"] == d:
            b[r["i"]] = r["v"]
        else:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["v"]
    model.weights = np.linalg.solve(a + RIDGE * a[-1, -1] * np.eye(d) / d, b)

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = np.clip(model.raw(np.array(f["stats"].tolist()).reshape(len(f), STATS)), -1, 2)
            yield pd.DataFrame({"bin": np.floor(raw * BINS).astype(int), "y": f["y"]})

    curve = sorted(rows.mapInPandas(bins, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).collect())
    x, y, w = (np.array(v, float) for v in zip(*curve))
    model.knots, model.values = (x + 0.5) / BINS, isotonic(x, y, w)
    return model


def labelled(rows: DataFrame, labels: DataFrame, target: str, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` joined with the mean of their non-null 0 / 1 labels as ``y``; rows or labels with a null id never match."""
    y = labels.filter(F.col(target).isin(0, 1)).groupBy(F.col("doc_id").alias("__i")).agg(F.avg(target).alias("y"))
    return rows.join(y, rows[doc_id] == y["__i"]).drop("__i")


def score_stats(df: DataFrame, model: QualityModel) -> DataFrame:
    """``df`` (with stats) with ``score`` and ``predicted``, without stats."""
    from pyspark.sql.types import DoubleType

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(s.tolist()).reshape(len(s), STATS)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    f = F.pandas_udf(run, DoubleType())
    return df.withColumn("score", f("stats")).drop("stats").withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def score_text(df: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with a score column from the whole text, all other columns as they were."""
    def make():
        def f(texts: list) -> dict:
            return {into: model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), STATS))}
        return f

    return with_text_column(df, text, make, f"{into} double")


def predict_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held out (crc32 of the id modulo 5 is 0) or without an
    id: never learned from. Null and empty texts are scored from their (zero) statistics; equal texts get equal scores."""
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    stats = checkpointed(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"))
    model = fit(labelled(stats.filter(~held), labels, "quality"))
    return score_stats(stats.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")
