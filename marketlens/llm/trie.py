"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a sum over its turns of hashes of (place, role, text), 128 bits in
all, so prefixes are compared by running sums that are chunked inside a long conversation; a node's parent is the same sum
without the last turn. Sums over subtrees come from a centroid decomposition of the parent edges: in each component the deepest
node whose part of the component holds over half of its load is cut out, the total below it is added along the path from there
to the top, and what is above it and below each of its children are the next components. The load of a node is the number of
its members, whose subtree sums are known from the lengths of conversations, so loads at least halve with every cut. Components
of a small load are summed in one task each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import balanced_chunks
from .common import HOT, split_join, written
from .mixing import words as count_words

#: Conversations share the start of the conversation at the next lower multiple of SHARED.
SHARED, STARTS = 20, 4
#: Load up to which a component is summed in one task, and nodes of such a task.
SMALL, TASK_NODES = 1 << 14, 1 << 15
#: Places of a path that are listed at once.
RUN = 4096


def shared_start(conv: Column) -> tuple[Column, Column]:
    """The conversation whose first turns another one takes, and how many it takes."""
    return conv - conv % SHARED, (F.crc32(conv.cast("string").cast("binary")) % STARTS).cast("int")


def _mix(at: Column, salt: int, a: Column, b: Column) -> list[Column]:
    h = F.xxhash64(F.lit(salt), at, a, b)
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def _key(at: Column, sums: list[Column]) -> Column:
    return F.struct(F.xxhash64(F.lit(1), at, *sums).alias("a"), F.xxhash64(F.lit(2), at, *sums).alias("b"))


def root_key() -> Column:
    return _key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)


def prefixes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per rebuilt conversation and prefix, the empty one included: conv, depth, node, parent (null at depth 0), words
    of the last text, length of the conversation.

    Turns count by ``turn``, null first; equal ones by a hash of role and text, repeated rows are turns of their own. Null role
    or text is empty. Rows without a conversation id belong to none and are left out. Other columns are not read.
    """
    said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("x"),
        F.xxhash64(F.lit(2), *said).alias("y"), count_words(said[1]).alias("words"))
    src = balanced_chunks(src, ["conv"], ["turn", "x", "y"], "chunk")
    by_chunk = Window.partitionBy("conv").orderBy("chunk")
    chunks = src.groupBy("conv", "chunk").agg(F.count("*").alias("n")).select(
        "conv", "chunk", (F.sum("n").over(by_chunk) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("conv")).alias("own"))
    place = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy("turn", "x", "y")) + F.col("before")
    placed = src.join(chunks.select("conv", "chunk", "before"), ["conv", "chunk"]).withColumn("place", place)
    starts = (placed.filter((F.col("conv") % SHARED == 0) & (F.col("place") < STARTS)).groupBy("conv")
              .agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "words"))).alias("start")).withColumnRenamed("conv", "base"))
    base, taken = shared_start(F.col("conv"))
    convs = (src.groupBy("conv").agg(F.count("*").alias("own")).withColumn("base", base).withColumn("taken", taken).join(starts, "base", "left")
             .withColumn("start", F.slice(F.coalesce("start", F.array().cast(starts.schema["start"].dataType)), F.lit(1), F.col("taken")))
             .select("conv", "taken", "start", (F.size("start") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("length")))

    # own turns behind the shared start: their place is known per chunk, their sums are carried from chunk to chunk
    at = (F.col("place") - F.col("taken") + F.col("shared")).cast("long")
    info = chunks.join(convs.select("conv", "taken", F.size("start").alias("shared"), "length"), "conv")
    mine = (src.join(info, ["conv", "chunk"]).withColumn("place", place).filter(F.col("place") > F.col("taken"))
            .select("conv", "chunk", at.alias("depth"), "x", "y", "words", "length"))
    # turns of the shared start, at most three a conversation
    given = convs.select("conv", F.lit(-1).cast("long").alias("chunk"), F.posexplode("start").alias("i", "t"), "length").select(
        "conv", "chunk", (F.col("i") + 1).cast("long").alias("depth"), "t.x", "t.y", "t.words", "length")
    turns = mine.unionByName(given)
    names = ["m0", "m1", "m2", "m3"]
    mixed = turns.select("conv", "chunk", "depth", "words", "length",
                         *[m.alias(n) for m, n in zip(_mix(F.col("depth"), 1, F.col("x"), F.col("y")) + _mix(F.col("depth"), 2, F.col("x"), F.col("y")), names)])
    carried = mixed.groupBy("conv", "chunk").agg(*[F.sum(n).alias(n) for n in names]).select(
        "conv", "chunk", *[(F.sum(n).over(by_chunk) - F.col(n)).alias(f"c{n}") for n in names])
    inside = Window.partitionBy("conv", "chunk").orderBy("depth")
    summed = mixed.join(carried, ["conv", "chunk"]).select(
        "conv", "depth", "words", "length", *names, *[(F.sum(n).over(inside) + F.col(f"c{n}")).alias(f"s{n}") for n in names])
    sums = [F.col(f"s{n}") for n in names]
    rows = summed.select("conv", "depth", _key(F.col("depth"), sums).alias("node"),
                         _key(F.col("depth") - 1, [s - F.col(n) for s, n in zip(sums, names)]).alias("parent"), "words", "length")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), root_key().alias("node"),
                        F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("words"), "length")
    return rows.unionByName(root)


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node of ``prefixes``: node, parent, depth, conv (smallest member), n_convs, words, load (turns of its
    members from here on), n_children."""
    nodes = rows.groupBy("node", "parent", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
                                                        F.sum(F.col("length") - F.col("depth") + 1).cast("long").alias("load"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, "node", "left").fillna(0, ["n_children"])


def rollup(nodes: DataFrame, rows: DataFrame, values: list[str], small: int = SMALL, task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, *values): each value summed over the node's subtree, by centroid decomposition.

    ``nodes``: node, parent, depth, conv, load and the values (long, not null), of a trie whose paths are in ``rows``: node
    and parent of every (conv, depth). The cuts of one level are found, summed and added by joins and partial sums; a key is
    never larger than 1 / HOT of the rows in a shuffled join.
    """
    n = nodes.count()
    hot = max(1, n // HOT)
    sums = [f"s_{v}" for v in values]
    root = nodes.filter("parent IS NULL").agg(F.max("load")).first()[0] or 0
    state = written(nodes.select("node", "parent", "conv", "depth", "load", *values, *[F.lit(0).cast("long").alias(s) for s in sums],
                                 root_key().alias("comp"), F.lit(root).cast("long").alias("total")))
    paths = rows.select("conv", "depth", "node", "parent")
    finished: list[DataFrame] = []
    while True:
        whole = state.filter(F.col("total") > small)
        finished.append(_small(state.filter(F.col("total") <= small), values, sums, task_nodes, n))
        if whole.isEmpty():
            break
        half = F.when(2 * F.col("load") > F.col("total"), F.struct("depth", "node", "conv", "load"))
        cut = whole.groupBy("comp").agg(F.count("*").alias("rows"), F.max(half).alias("c"))
        cut = written(cut.select("comp", "rows", F.col("c.node").alias("c_node"), F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.load").alias("c_load")))
        known = split_join(whole, cut, ["comp"], F.col("rows") >= hot).drop("rows")
        # where a deeper node hangs below the centroid's depth: one look-up per component and smallest member
        deeper = known.filter(F.col("depth") > F.col("c_depth"))
        look = (deeper.groupBy("comp", "conv", "c_node", "c_depth").agg(F.count("*").alias("rows"))
                .join(paths.select("conv", (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("branch"), F.col("parent").alias("above")), ["conv", "c_depth"])
                .filter(F.col("above") == F.col("c_node"))
                .join(whole.select(F.col("node").alias("branch"), F.col("load").alias("branch_load")), "branch")
                .select("comp", "conv", "branch", "branch_load", "rows"))
        below = split_join(deeper, look, ["comp", "conv"], F.col("rows") >= hot, "left").drop("rows")
        rest = known.filter(F.col("depth") <= F.col("c_depth")).withColumns({"branch": F.lit(None).cast(look.schema["branch"].dataType), "branch_load": F.lit(None).cast("long")})
        placed = written(below.unionByName(rest))
        under = F.col("branch").isNotNull() | (F.col("node") == F.col("c_node"))
        totals = placed.filter(under).groupBy("comp").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        # from the centroid up to the top of its component: the places of its smallest member
        tops = cut.join(totals, "comp").join(placed.groupBy("comp").agg(F.min("depth").alias("from")), "comp")
        run = F.expr(f"explode(sequence(from div {RUN}, c_depth div {RUN}))").alias("run")
        step = F.expr(f"explode(sequence(greatest(from, run * {RUN}), least(c_depth, run * {RUN} + {RUN - 1})))").alias("depth")
        path = (tops.select("*", run).select(F.col("c_conv").alias("conv"), F.col("c_load").alias("cut_load"), *[f"t_{v}" for v in values], step)
                .join(paths.select("conv", "depth", "node"), ["conv", "depth"]).select("node", "cut_load", *[f"t_{v}" for v in values]))
        added = placed.join(path, "node", "left").withColumns({s: F.col(s) + F.coalesce(f"t_{v}", F.lit(0)) for s, v in zip(sums, values)})
        done = F.col("node") == F.col("c_node")
        finished.append(written(added.filter(done).select("node", *[F.col(s).alias(v) for s, v in zip(sums, values)])))
        is_below = F.col("branch").isNotNull()
        state = written(added.filter(~done).select(
            "node", "parent", "conv", "depth", (F.col("load") - F.coalesce("cut_load", F.lit(0))).alias("load"), *values, *sums,
            F.when(is_below, F.col("branch")).otherwise(F.col("comp")).alias("comp"),
            F.when(is_below, F.col("branch_load")).otherwise(F.col("total") - F.col("c_load")).alias("total")))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def _small(state: DataFrame, values: list[str], sums: list[str], task_nodes: int, n: int) -> DataFrame:
    """Sums of components of a small load: each lies in one task whole, deepest nodes first."""

    def add(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("depth", ascending=False, ignore_index=True)
        at = {(a, b): i for i, (a, b) in enumerate(zip(df["a"], df["b"]))}
        ups = [at.get(k) for k in zip(df["pa"], df["pb"])]
        for v, s in zip(values, sums):
            own = df[v].tolist()
            for i, up in enumerate(ups):
                if up is not None:
                    own[up] += own[i]
            df[v] = np.array(own, np.int64) + df[s]
        return df[["a", "b", *values]]

    buckets = n // task_nodes + 1
    flat = state.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.coalesce("parent.a", F.lit(0)).alias("pa"), F.coalesce("parent.b", F.lit(0)).alias("pb"),
                        "depth", *values, *sums, F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket"))
    out = flat.groupBy("bucket").applyInPandas(add, ", ".join(["a long", "b long", *[f"{v} long" for v in values]]))
    return out.select(F.struct("a", "b").alias("node"), *values)


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: SHA-256 of their ids in order, comma-joined.

    A digest can't be computed in parts, so a node's ids pass through one task; they come there as ready pieces of many ids,
    made by tasks that share a node, and are never held together."""
    ends = rows.filter(F.col("depth") == F.col("length")).select("node.a", "node.b", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, conv = (batch[c].to_numpy() for c in ("a", "b", "conv"))
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            ends = np.concatenate([new[1:], [len(a)]])
            text = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(new, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(conv[new]), pa.array(text, pa.string())], ["a", "b", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist()):
                if (a, b) == now:
                    h.update(b"," + ids.encode())
                else:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = (a, b), hashlib.sha256(ids.encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, h.hexdigest())])

    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(join, "a long, b long, first long, ids string")
    done = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")
    return done.select(F.struct("a", "b").alias("node"), "ends_sha256")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, h = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], ["a", "b", "ends_sha256"])


def trie(conversations: DataFrame, small: int = SMALL, **names: str) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Nulls, ties and repeated rows as in ``prefixes``; an empty table has no conversation and gives no row."""
    rows = written(prefixes(conversations, **names))
    nodes = written(nodes_of(rows).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    n = nodes.count()
    sums = rollup(nodes.drop("n_children", "n_convs", "words"), rows, ["n_leaves", "saved_tokens"], small)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    out = split_join(nodes.drop("n_leaves", "saved_tokens", "words"), parents, ["parent"], F.col("rows") >= max(1, n // HOT), "left")
    out = out.join(sums, "node").join(end_digests(rows), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: The result in DuckDB. CRC-32 is spelled out bit by bit (its polynomial, reflected, is the fixed value 3988292384).
TWIN = """
WITH t AS (SELECT conv_id::BIGINT AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS own FROM t GROUP BY c),
ids AS (SELECT c, c - c % 20 AS b, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1),
               lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
               lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h FROM own),
convs AS (SELECT ids.*, least(h, coalesce(base.own, 0)) AS m FROM ids LEFT JOIN own AS base ON base.c = ids.b),
turns AS (SELECT convs.c, p AS d, r, x FROM convs JOIN t ON t.c = convs.b AND t.p <= convs.h
          UNION ALL SELECT convs.c, p - h + m, r, x FROM convs JOIN t ON t.c = convs.c WHERE p > h
          UNION ALL SELECT c, 0, '', '' FROM convs),
keyed AS (SELECT c, d, x, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS k,
                 max(d) OVER (PARTITION BY c) AS len FROM turns),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM keyed),
nodes AS (SELECT k, up, d, min(c) AS c, count(*) AS n, min(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS w FROM linked GROUP BY k, up, d),
kids AS (SELECT up AS k, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (SELECT a.k, sum(CASE WHEN kids.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.w) AS saved
         FROM nodes AS u LEFT JOIN kids ON kids.k = u.k JOIN linked AS a ON a.c = u.c AND a.d <= u.d GROUP BY a.k),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM linked WHERE d = len GROUP BY k)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.kids, 0) AS n_children,
       sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes AS v LEFT JOIN nodes AS p ON p.k = v.up LEFT JOIN kids ON kids.k = v.k JOIN sums ON sums.k = v.k LEFT JOIN ends ON ends.k = v.k
"""
