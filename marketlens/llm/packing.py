"""Best-fit packing of token pieces into sequences, by bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, with_text_column
from .tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: full ones, behind a shorter first one where n is no multiple."""
    return [n % capacity][: 1 if n % capacity else 0] + [capacity] * (n // capacity)


def with_pieces(df: DataFrame, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, ids: bool = True) -> DataFrame:
    """``df`` with ``pieces``: array of (piece, start, length, ids_crc32[, ids]) of each whole text (null: empty) and the
    end id behind it. Only texts of more than ``capacity`` ids are cut."""
    path = path or default_path()

    def make():
        enc = encoder(path)

        def f(texts: list) -> dict:
            all_ids = [enc.encode(t or "", end_id) for t in texts]
            flat, sizes = np.concatenate([np.zeros(0, "<u4"), *all_ids]), np.fromiter(map(len, all_ids), np.int64, len(all_ids))
            count = -(-sizes // capacity)
            rows, doc = np.arange(count.sum()), np.repeat(np.arange(len(sizes)), count)
            piece = rows - np.repeat(np.cumsum(count) - count, count)
            short = (sizes - (count - 1) * capacity)[doc]  # the first piece; the others are full
            start = np.where(piece > 0, short + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short)
            at = start + (np.cumsum(sizes) - sizes)[doc]
            data = memoryview(flat.tobytes())
            crc = [zlib.crc32(data[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            cols = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
            if ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.view(np.int32)))
            struct = pa.StructArray.from_arrays(list(cols.values()), names=list(cols))
            return {"pieces": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), struct)}
        return f

    kind = "piece: int, start: bigint, length: bigint, ids_crc32: bigint" + (", ids: array<int>" if ids else "")
    return with_text_column(df, text, make, f"pieces array<struct<{kind}>>")


def ranked(df: DataFrame, size: str, *ties: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` range-sorted by ``size`` and ``ties``, with ``rank`` (0, 1, ... within each size), and the rows per size.

    One shuffle; a frequent size is split over as many range partitions as its rows need. What comes to the driver is one
    row per (partition, size): at most the partitions plus the sizes, since the order is by size."""
    x = df.repartitionByRange(size, *ties).sortWithinPartitions(size, *ties)
    schema = [f"`{n}` {t}" for n, t in x.dtypes] + ["__p int", "__k long"]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for f in frames:
            if len(f):
                before = f[size].map(lambda s: seen.get(s, 0))
                k = f.groupby(size).cumcount() + before
                for s, n in f[size].value_counts().items():
                    seen[s] = seen.get(s, 0) + n
                yield f.assign(__p=task, __k=k)

    x = checkpointed(x.mapInPandas(count, ", ".join(schema)))
    parts = sorted(tuple(r) for r in x.groupBy(size, "__p").agg(F.count("*")).collect())
    total: dict[int, int] = {}
    base = []
    for s, p, n in parts:
        base.append((s, p, total.get(s, 0)))
        total[s] = total.get(s, 0) + n
    if not base:
        return x.select(*df.columns, F.col("__k").alias("rank")), total
    b = df.sparkSession.createDataFrame(base, f"__s {dict(x.dtypes)[size]}, __q int, __b long")
    x = x.join(F.broadcast(b), (x[size] == b["__s"]) & (x["__p"] == b["__q"]))
    return x.select(*df.columns, (F.col("__k") + F.col("__b")).alias("rank")), total


def sweep(docs: dict[int, tuple[int, int]], slots: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Successor sweep over sizes, largest first: each document takes the tightest slot still free.

    docs: size -> (first rank, end rank) not yet placed; slots: size -> count. Returns runs
    (doc size, first rank, end rank, slot size, first slot rank): documents meet slots rank by rank, so no two want one."""
    stack: list[list[int]] = []
    runs = []
    for s in sorted({*docs, *slots}, reverse=True):
        if slots.get(s):
            stack.append([s, 0, slots[s]])
        at, end = docs.get(s, (0, 0))
        while at < end and stack:
            q, r, left = stack[-1]
            n = min(left, end - at)
            runs.append((s, at, at + n, q, r))
            at += n
            stack[-1][1:] = [r + n, left - n]
            if left == n:
                stack.pop()
    return runs


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``df`` (lengths from 1 to ``capacity``) with sequence_id and offset; no sequence exceeds ``capacity``, offsets are
    gapless from 0. Rows without a usable length (null, below 1, above capacity) get nulls.

    Full rows fill a sequence each. For the others, each round sorts documents and gaps by size (range sort, ranks),
    matches every document with the tightest gap that a sweep over the sizes leaves for it, lets equal claims be settled
    by rank, updates the gaps and repeats; the largest documents that no gap takes open new sequences, never more than
    their total length needs beyond the free space. A gap of at least twice the largest document left offers several
    slots. The sweep itself works on counts per size: at most ``capacity`` numbers, whatever the rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    columns = [c for c in df.columns if c not in ("sequence_id", "offset")]
    rows = checkpointed(df.select(*columns).withColumn("__u", F.monotonically_increasing_id()))
    usable = F.coalesce(F.col(length).between(1, capacity), F.lit(False))
    # the sort needs no more than a row's number and length
    docs, count = ranked(rows.filter(usable & (F.col(length) < capacity)).select("__u", F.col(length).cast("int").alias("size")), "size", "__u")
    docs = checkpointed(docs)
    left = {s: (0, n) for s, n in count.items()}
    bins = None  # (bin, gap)
    placed: list[DataFrame] = []
    opened = 0
    for turn in count_up():
        left = {s: x for s, x in left.items() if x[0] < x[1]}
        if not left:
            break
        top, low = max(left), min(left)
        gaps = {r["gap"]: r["n"] for r in bins.groupBy("gap").agg(F.count("*").alias("n")).collect()} if bins is not None else {}
        many = {g: max(1, g // top) for g in gaps if g >= low}
        slot_counts: dict[int, int] = {}
        for g, m in many.items():
            slot_counts[g // m] = slot_counts.get(g // m, 0) + gaps[g] * m
        runs = sweep(left, slot_counts)
        for s, a, b, _, _ in runs:
            left[s] = (b, left[s][1])
        waiting = sum(s * (b - a) for s, (a, b) in left.items())
        free = sum(g * n for g, n in gaps.items()) - sum(s * (b - a) for s, a, b, _, _ in runs)
        need = -(-waiting // capacity) if not runs else -(-max(0, waiting - free) // capacity)
        need = max(need, sum(b - a for s, (a, b) in left.items() if 2 * s > capacity))
        fresh = []  # (size, first rank, end rank, first new bin)
        for s in sorted(left, reverse=True):
            a, b = left[s]
            n = min(need, b - a)
            if n > 0:
                fresh.append((s, a, a + n, opened))
                left[s] = (a + n, b)
                need -= n
                opened += n
        news = []
        if runs:
            table = spark.createDataFrame(runs, "s int, a long, b long, q int, r long")
            m = F.greatest(F.floor(F.col("gap") / top), F.lit(1))
            used = {q for _, _, _, q, _ in runs}
            slots = bins.filter(F.col("gap") >= low).withColumn("m", m).select("bin", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).alias("slot"), F.floor(F.col("gap") / F.col("m")).cast("int").alias("q"))
            slots, _ = ranked(slots.filter(F.col("q").isin(*used)), "q", "bin", "slot")
            want = docs.join(F.broadcast(table), (docs["size"] == table["s"]) & (docs["rank"] >= table["a"]) & (docs["rank"] < table["b"]))
            want = want.select("__u", "size", "q", (F.col("r") + F.col("rank") - F.col("a")).alias("rank"))
            news.append(slots.join(want, ["q", "rank"]).select("__u", "bin", "size", F.lit(turn).alias("turn"), "slot"))
        if fresh:
            table = spark.createDataFrame(fresh, "s int, a long, b long, o long")
            own = docs.join(F.broadcast(table), (docs["size"] == table["s"]) & (docs["rank"] >= table["a"]) & (docs["rank"] < table["b"]))
            news.append(own.select("__u", (F.col("o") + F.col("rank") - F.col("a")).alias("bin"), "size", F.lit(turn).alias("turn"), F.lit(0).alias("slot")))
        now = checkpointed(news[0].unionByName(news[1]) if len(news) == 2 else news[0])
        placed.append(now)
        taken = now.groupBy("bin").agg(F.sum("size").alias("n"))
        if any(a < b for a, b in left.values()):
            old = bins if bins is not None else None
            if old is None:
                bins = taken.select("bin", (F.lit(capacity) - F.col("n")).cast("int").alias("gap"))
            else:
                bins = old.join(taken, "bin", "full").select("bin", (F.coalesce("gap", F.lit(capacity)) - F.coalesce("n", F.lit(0))).cast("int").alias("gap"))
            bins = checkpointed(bins.filter("gap > 0"))
    full = rows.filter(usable & (F.col(length) == capacity)).select("__u", (F.monotonically_increasing_id() + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in placed[:1]:
        all_placed = p
        for more in placed[1:]:
            all_placed = all_placed.unionByName(more)
        full = full.unionByName(all_placed.select("__u", F.col("bin").alias("sequence_id"), offset_in_bin()))
    out = rows.join(full.withColumnRenamed("__u", "__v"), F.col("__u") == F.col("__v"), "left")
    return out.select(*columns, "sequence_id", "offset")


def offset_in_bin():
    """Length of what came into the sequence before this row; a sequence holds at most CAPACITY rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("bin").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("offset")


def pack_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset. Null and
    empty texts are one piece that holds the end id alone. Repeated rows are packed as often as they come; null ids stay
    null. Empty table: empty result."""
    x = with_pieces(docs.select("doc_id", F.col(text).alias("__t")), "__t", capacity, ids=ids)
    x = x.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    return pack(x, "length", capacity)
