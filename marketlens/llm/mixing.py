"""Temperature mixing of sources to target weights, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Entropy of the mixed weights as a share of its maximum (the log of the number of sources), and how often a document
#: may come at most on average over its source. The repetition limit wins where both cannot be met.
TARGET_ENTROPY, MAX_EPOCHS = 0.9, 2.0
#: Hash digits that name a block of a source's permutation: 16^3 blocks.
BLOCK_DIGITS = 3
#: Up to so many sources their table (some 100 bytes a row) is broadcast to the documents; beyond it Spark chooses the join.
BROADCAST_SOURCES = 50_000
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str | Column) -> Column:
    """White-space separated words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def key(doc_id: str, epoch: Column) -> Column:
    """Place of a document in the permutation of its source in one epoch: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), epoch.cast("string")).cast("binary"))


def fraction(k: Column) -> Column:
    """A key as a number from 0 to 1 (its first 13 digits)."""
    return F.conv(F.substring(k, 1, 13), 16, 10).cast("long").cast("double") / float(16**13)


@dataclass
class Bracket:
    lo: float
    hi: float


def exponent(shares: DataFrame, target: float, ratio: float, max_epochs: float, jobs: int = 8) -> float:
    """The exponent a in [0, 1] of the weights p^a / sum p^a: the largest at which their entropy reaches ``target``, but no
    smaller than the one at which the smallest source comes ``max_epochs`` times. ``shares``: p > 0, one row per source;
    ``ratio``: budget over all tokens.

    Both conditions are monotone in a. Each job halves both brackets five times: it sums over the sources for 31 inner
    points, so 31 rows come back whatever the number of sources.
    """
    ends = {"entropy": Bracket(0.0, 1.0), "epochs": Bracket(0.0, 1.0)}
    for _ in range(jobs):
        points = {k: [b.lo + (b.hi - b.lo) * i / 32 for i in range(1, 32)] for k, b in ends.items()}
        grid = [F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(a).alias("a")) for k, p in points.items() for i, a in enumerate(p)]
        x = shares.select("p", F.explode(F.array(*grid)).alias("g")).select("p", "g.*")
        pa = F.pow("p", F.col("a"))
        got = x.groupBy("k", "i", "a").agg(F.sum(pa).alias("z"), F.sum(pa * F.ln("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("m")).collect()
        for k, b in ends.items():
            ok = [r["a"] for r in got if r["k"] == k and (math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= target if k == "entropy" else ratio * r["m"] / r["z"] > max_epochs)]
            lo = max(ok, default=b.lo)  # entropy: still reached; epochs: still too often
            b.lo, b.hi = lo, min([p for p in points[k] if p > lo], default=b.hi)
    at_one = shares.agg(-F.sum(F.col("p") * F.ln("p"))).first()[0]
    by_entropy = 1.0 if at_one >= target else (ends["entropy"].lo + ends["entropy"].hi) / 2
    by_epochs = (ends["epochs"].lo + ends["epochs"].hi) / 2 if ends["epochs"].lo > 0 or _too_often(shares, 0.0, ratio, max_epochs) else 0.0
    return round(max(by_entropy, by_epochs), 6)


def _too_often(shares: DataFrame, a: float, ratio: float, max_epochs: float) -> bool:
    r = shares.agg(F.max(F.pow("p", F.lit(a - 1))), F.sum(F.pow("p", F.lit(a)))).first()
    return ratio * r[0] / r[1] > max_epochs


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", target_entropy: float = TARGET_ENTROPY,
         max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """One row per source with words: source, tokens, weight, quota (words to emit), full (whole epochs) and cut (last key
    of the epoch behind them; '' for none). ``budget``: words of the mixture, all words of ``docs`` by default.

    The cut is where the permutation's running sum of words passes what is left of the quota: summed over blocks of
    the permutation first, then inside the one block that holds the cut, so no task sees a whole source."""
    light = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("n")))
    sums = checkpointed(light.groupBy("source").agg(F.sum("n").alias("tokens")).filter("tokens > 0"))
    total, n_sources = sums.agg(F.sum("tokens"), F.count("*")).first()
    if not n_sources:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(0).cast("long").alias("full"), F.lit("").alias("cut"))
    budget = total if budget is None else budget
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares, target_entropy * math.log(n_sources), budget / total, max_epochs)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    quota = F.least(F.floor(weight * F.lit(float(budget))), F.floor(F.col("tokens") * F.lit(float(max_epochs)))).cast("long")
    base = checkpointed(shares.select("source", "tokens", weight.alias("weight"), quota.alias("quota")).withColumn("full", F.floor(F.col("quota") / F.col("tokens")).cast("long")).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")))
    b = base.select(F.col("source").alias("s"), "full", "rest")
    x = light.join(b, F.col("source").eqNullSafe(F.col("s"))).select("source", "rest", "n", key("doc_id", F.col("full")).alias("k"))
    block = F.substring("k", 1, BLOCK_DIGITS)
    blocks = x.groupBy("source", block.alias("block"), "rest").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    # the first block whose end passes the rest holds the cut
    at = blocks.withColumn("end", so_far).filter("end > rest").groupBy("source").agg(F.min_by(F.struct("block", (F.col("end") - F.col("n")).alias("start")), "block").alias("c"))
    at = checkpointed(at.select(F.col("source").alias("s"), F.col("c.block").alias("b"), F.col("c.start").alias("start")))
    inside = x.withColumn("block", block).join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    end = F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy("k"))
    inside = inside.withColumn("end", end).filter("end <= rest").groupBy("source").agg(F.max("k").alias("last"))
    cuts = at.join(inside.select(F.col("source").alias("s2"), "last"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("last", F.col("b")).alias("cut"))
    out = base.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", "weight", "quota", "full", F.coalesce("cut", F.lit("")).alias("cut"))
    return checkpointed(out)


def mix(docs: DataFrame, sources: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as ``sources`` (from ``plan``) says, with epoch, at and weight.

    Each whole epoch holds every row of the source, the last one those up to the cut; rows by rising ``at`` (0 to 1) are
    the mixture, in which every stretch has the sources in their weights. A source without words is left out; a null
    source is a source like others; repeated rows of one id come or stay out together. The table of sources, if not
    larger than BROADCAST_SOURCES, is broadcast: then no text moves. Columns of ``docs`` named epoch, at or weight are replaced."""
    columns = [c for c in docs.columns if c not in ("epoch", "at", "weight")]
    s = sources.select(F.col("source").alias("__s"), F.col("tokens").alias("__t"), F.col("weight").alias("__w"), F.col("quota").alias("__q"), F.col("full").alias("__f"), F.col("cut").alias("__c"))
    if sources.count() <= BROADCAST_SOURCES:
        s = F.broadcast(s)
    x = docs.select(*columns).join(s, F.col(source).eqNullSafe(F.col("__s")))
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__f").cast("int")))).withColumn("__k", key(doc_id, F.col("epoch")))
    x = x.filter((F.col("epoch") < F.col("__f")) | (F.col("__k") <= F.col("__c")))
    at = (F.col("epoch") + fraction(F.col("__k"))) * F.col("__t") / F.col("__q")
    return x.select(*columns, "epoch", F.least(at, F.lit(1.0)).alias("at"), F.col("__w").alias("weight"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per emitted document: doc_id, source, epoch, n_words, weight, at."""
    docs = docs.select("doc_id", "source", "text")
    out = mix(docs.select("doc_id", "source", words("text").alias("n_words")), plan(docs))
    return out.select("doc_id", "source", "epoch", "n_words", F.round("weight", 9).alias("weight"), F.round("at", 9).alias("at"))


TWIN = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
g AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS k FROM s),
p AS (SELECT source, tokens, tokens::DOUBLE / total::DOUBLE AS p FROM s, g),
l AS (SELECT list(p) AS ps, ln(count(*)) * {TARGET_ENTROPY}::DOUBLE AS target, -sum(p * ln(p)) AS h1 FROM p),
e AS (SELECT h1 >= target AS reached, list_reduce(list_prepend([0.0::DOUBLE, 1.0::DOUBLE], list_transform(range(50), lambda i: [0.0::DOUBLE, 1.0::DOUBLE])),
  lambda b, i: CASE WHEN ln(list_sum(list_transform(ps, lambda q: pow(q, (b[1] + b[2]) / 2))))
      - (b[1] + b[2]) / 2 * list_sum(list_transform(ps, lambda q: pow(q, (b[1] + b[2]) / 2) * ln(q))) / list_sum(list_transform(ps, lambda q: pow(q, (b[1] + b[2]) / 2))) >= target
    THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END) AS b,
  list_reduce(list_prepend([0.0::DOUBLE, 1.0::DOUBLE], list_transform(range(50), lambda i: [0.0::DOUBLE, 1.0::DOUBLE])),
  lambda b, i: CASE WHEN list_max(list_transform(ps, lambda q: pow(q, (b[1] + b[2]) / 2 - 1))) / list_sum(list_transform(ps, lambda q: pow(q, (b[1] + b[2]) / 2))) > {MAX_EPOCHS}
    THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END) AS r,
  list_max(list_transform(ps, lambda q: 1 / q)) / len(ps) > {MAX_EPOCHS} AS often FROM l),
a AS (SELECT round(greatest(CASE WHEN reached THEN 1.0 ELSE (b[1] + b[2]) / 2 END, CASE WHEN often THEN (r[1] + r[2]) / 2 ELSE 0.0 END), 6) AS a FROM e),
z AS (SELECT sum(pow(p, a)) AS z FROM p, a),
w AS (SELECT source, tokens, pow(p, a) / z AS weight, least(floor(pow(p, a) / z * total::DOUBLE), floor(tokens * {MAX_EPOCHS}::DOUBLE))::BIGINT AS quota FROM p, a, z, g),
f AS (SELECT *, quota // tokens AS full_, quota - quota // tokens * tokens AS rest FROM w),
x AS (SELECT d.*, f.tokens, f.weight, f.quota, f.full_, f.rest, e.epoch, md5(coalesce(doc_id::VARCHAR, '') || '|' || e.epoch) AS k
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN (SELECT unnest(range(0, 4)) AS epoch) e ON e.epoch <= f.full_),
c AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY k) AS cum FROM x)
SELECT doc_id, source, epoch::INTEGER AS epoch, n AS n_words, round(weight, 9) AS weight,
  round(least((epoch + ('0x' || substr(k, 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE) * tokens / quota, 1.0), 9) AS at
FROM c WHERE epoch < full_ OR cum <= rest
"""
