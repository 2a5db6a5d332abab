"""Ordered computations over keys too large for one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one task, so a key with a
third of all rows cannot scale. Everything ordered in this library goes through two shapes:

* ``running``: rows are windowed inside (key, time chunk); one small row per chunk carries the
  state of all earlier chunks. The only per-key window is over those chunk rows, whose number is
  bounded by time span / chunk width, not by the data.
* ``lookback`` / ``time_halo``: a bounded frame needs only rows near a chunk border, so border
  rows are copied into the next chunk by a narrow ``explode`` and dropped after the window.

Keys and times may be null: a null key is a key like others, and rows without a time come first. Chunks
are matched back to rows by one struct column, in which nulls are equal, so the rows move once.

A time chunk is as large as the data in it. ``balanced_chunks`` instead cuts by rows: chunks are range
partitions over (keys, order), so no task gets more than about its share, however dense one key or day is. Operators
cut by rows unless their caller gives a width.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import epoch_us, int_div

CHUNK = "_chunk"
PART = "_part"
BLOCK = "_blk"
INDEX = "_idx"
OWN = "_own"

Aggs = dict[str, tuple[str, Column]]
_WINDOW_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def with_part(df: DataFrame, cols: Sequence[str], name: str = PART) -> DataFrame:
    """Adds one struct of the given columns: never null itself, equal where all fields are equal or both null."""
    return df.withColumn(name, F.struct(*[F.col(x) for x in cols]) if cols else F.struct(F.lit(0).alias("_")))


def part_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{PART}.{k}") for k in keys]


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set only where none is configured and all tasks run on this machine
    (tests). Raises on a cluster without one: executors would write to folders of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table below the checkpoint folder. For loops of joins: a checkpoint keeps the planner's guess of its size, which
    such a loop multiplies from round to round; a written table has its true one."""
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balanced_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = CHUNK) -> DataFrame:
    """Adds a chunk number that grows with (keys, order) and holds about equally many rows.

    Chunks are the range partitions of one sort over sampled bounds; they are written to the checkpoint folder, so
    that every later use sees the same ones. Equal (keys, order) stay together: make ``order`` unique.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *[F.col(x) for x in [*keys, *order]]).withColumn(name, F.spark_partition_id().cast("bigint")))


def add_chunk(df: DataFrame, ts: str, width_s: float, name: str = CHUNK) -> DataFrame:
    """Adds the time-chunk number of a timestamp column."""
    return df.withColumn(name, int_div(epoch_us(ts), int(width_s * 1_000_000)))


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
    if kind == "last":
        return F.coalesce(inside, before)
    return (F.greatest if kind == "max" else F.least)(before, inside)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggs: Aggs, *, chunk: str = CHUNK,
            exclusive: bool = False) -> DataFrame:
    """Running sum / max / min / last-non-null per key in ``order``, at any key size.

    ``df`` must hold ``chunk``, monotone in ``order`` within a key. ``exclusive`` leaves the
    current row out of its own value. Rows move once, by (keys, chunk).
    """
    keys, order = list(keys), list(order)
    src = with_part(df.select("*", *[e.alias(f"_in_{n}") for n, (_, e) in aggs.items()]), [*keys, chunk])

    per_chunk, carry_w = [], Window.partitionBy(*part_keys(keys)).orderBy(F.col(f"{PART}.{chunk}")).rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in aggs.items():
        v = F.col(f"_in_{n}")
        agg = (F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) if kind == "last" else _WINDOW_FN[kind](v))
        per_chunk.append(agg.alias(f"_ag_{n}"))
    carry = src.groupBy(PART).agg(*per_chunk).select(PART, *[
        (F.last(f"_ag_{n}", True) if kind == "last" else _WINDOW_FN[kind](f"_ag_{n}")).over(carry_w).alias(f"_cy_{n}")
        for n, (kind, _) in aggs.items()])

    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    local_w = Window.partitionBy(PART).orderBy(*order).rowsBetween(*frame)
    inside = src.withColumns({
        f"_lo_{n}": (F.last(f"_in_{n}", True) if kind == "last" else _WINDOW_FN[kind](f"_in_{n}")).over(local_w)
        for n, (kind, _) in aggs.items()})
    out = inside.join(carry, PART, "left")
    return out.select(*[F.col(x) for x in df.columns],
                      *[_combine(k, F.col(f"_cy_{n}"), F.col(f"_lo_{n}")).alias(n) for n, (k, _) in aggs.items()])


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, ts: str, width_s: float | None,
                name: str = INDEX) -> DataFrame:
    """0-based position of each row within its key; counts per chunk are carried, rows are not.

    ``width_s`` None: chunks of equal row counts (``balanced_chunks``)."""
    keys = list(keys)
    src = with_part(balanced_chunks(df, keys, order) if width_s is None else add_chunk(df, ts, width_s), [*keys, CHUNK])
    before = src.groupBy(PART).agg(F.count(F.lit(1)).alias("_n")).select(
        PART, F.coalesce(F.sum("_n").over(
            Window.partitionBy(*part_keys(keys)).orderBy(F.col(f"{PART}.{CHUNK}")).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_before"))
    local = src.withColumn("_rn", F.row_number().over(Window.partitionBy(PART).orderBy(*order)))
    return local.join(before, PART).select(
        *[F.col(x) for x in df.columns], (F.col("_before") + F.col("_rn") - 1).alias(name))


def row_halo(df: DataFrame, n: int, block: int, idx: str = INDEX) -> DataFrame:
    """Copies the last ``n`` rows of each index block into the next one.

    Frames of up to ``n`` preceding rows are then exact in ``Window.partitionBy(keys, _blk)``.
    Filter on ``_own`` afterwards.
    """
    if n > block:
        raise ValueError(f"lookback of {n} rows does not fit a block of {block}")
    home = int_div(idx, block)
    near_end = F.col(idx) % block >= block - n
    return (df.withColumn(BLOCK, F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
            .withColumn(OWN, F.col(BLOCK) == home))


def lookback(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, *, ts: str, width_s: float | None,
             block: int = 65_536) -> DataFrame:
    """``dense_index`` + ``row_halo``: ready for any frame of at most ``n`` preceding rows."""
    return row_halo(dense_index(df, keys, order, ts=ts, width_s=width_s), n, block)


def block_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(INDEX)


def own_rows(df: DataFrame, *, keep_index: bool = False) -> DataFrame:
    """Drops halo copies and helper columns."""
    return df.where(OWN).drop(BLOCK, OWN, *([] if keep_index else [INDEX]))


def time_halo(df: DataFrame, ts: str, width_s: float, back_s: float) -> DataFrame:
    """Copies rows of the last ``back_s`` seconds of each chunk into every chunk they can reach.

    Frames reaching back up to ``back_s`` seconds are then exact in
    ``Window.partitionBy(keys, _chunk)``.
    """
    width, back, t = int(width_s * 1e6), int(back_s * 1e6), epoch_us(ts)
    home, reach = int_div(t, width), int_div(t + F.lit(back), width)
    chunks = F.coalesce(F.sequence(home, reach), F.array(home))  # a row without a time keeps the null chunk
    return (df.withColumn(CHUNK, F.explode(chunks))
            .withColumn(OWN, F.col(CHUNK).eqNullSafe(home)))
