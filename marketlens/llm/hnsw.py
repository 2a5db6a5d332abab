"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard of a label."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, components
from .simhash import unite

THRESHOLD = 0.98
#: Distinct vectors of one graph; a label with more is split by hash, and every shard is searched.
SHARD = 8192
#: Links per node (twice as many on the ground level), beam while building, first beam of a search, nodes expanded per step.
LINKS, BUILD_BEAM, BEAM, EXPAND = 12, 32, 16, 4
#: Vectors inserted or searched together.
TOGETHER = 256
#: Audit: queries compared with an exact scan of the shard, the recall they must reach, and the beam beyond which the
#: rest is scanned exactly.
AUDIT, RECALL, WIDEST = 64, 0.999, 256
#: Nodes of a shard from which copies are planted for the audit, and copies of each.
COPIES, COPIES_EACH = 512, 2


class Graph:
    """Navigable small-world graph over unit vectors (float32), built in batches."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray] | None = None, entry: int = 0, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        if levels is not None:
            self.levels, self.entry = levels, entry
            return
        n = len(x)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 6)
        first = int(np.argmax(height))  # the entry comes first, so every level is in place from the start
        self.entry = first
        self.levels = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        order = rng.permutation(n)
        order = np.concatenate([[first], order[order != first]])
        at, size = 1, 1
        while at < n:  # batches grow with the graph, so most members of a batch find their neighbours in it
            part = order[at: at + size]
            self.insert(part, height[part])
            at += len(part)
            size = min(TOGETHER, max(1, at // 2))

    def insert(self, part: np.ndarray, height: np.ndarray) -> None:
        start = np.full((len(part), 1), self.entry)
        q = self.x[part]
        for k in range(len(self.levels) - 1, -1, -1):
            own = height >= k
            nxt = np.empty((len(part), 1), start.dtype)
            if (~own).any():
                nxt[~own] = self.walk(q[~own], start[~own], k, EXPAND)[0][:, :1]
            if own.any():
                ids, sims = self.walk(q[own], start[own], k, BUILD_BEAM)
                nxt[own] = ids[:, :1]
                me = part[own]
                inner = q[own] @ q[own].T
                np.fill_diagonal(inner, -np.inf)
                near = np.argsort(-inner, axis=1, kind="stable")[:, : min(8, len(me) - 1)]
                ids = np.concatenate([ids, me[near]], 1)
                sims = np.concatenate([sims, np.take_along_axis(inner, near, 1)], 1)
                chosen = self.choose(ids, sims, LINKS)
                self.levels[k][me, :LINKS] = chosen
                self.link_back(k, np.repeat(me, LINKS), chosen.ravel())
            start = nxt

    def choose(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """At most ``limit`` candidates of each row: first those that are nearer to the row than to any chosen one, so
        that links leave dense groups, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = np.isfinite(sims)
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        n = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            ok = valid[:, c] & (n < limit) & ~((between[:, c] > sims[:, c, None]) & kept).any(1)
            kept[:, c] = ok
            n += ok
        rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :limit]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, limit - out.shape[1])), constant_values=-1)

    def link_back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        """Adds the links target -> source; a node with too many keeps a choice of them."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        width = self.levels[k].shape[1]
        for at in range(0, int(place.max(initial=-1)) + 1, width):
            now = (place >= at) & (place < at + width)
            nodes, row = np.unique(target[now], return_inverse=True)
            more = np.full((len(nodes), width), -1, np.int32)
            more[row, place[now] - at] = source[now]
            ids = np.concatenate([self.levels[k][nodes], more], 1)
            dup = (more[:, :, None] == self.levels[k][nodes][:, None, :]).any(2)
            sims = np.einsum("nd,nmd->nm", self.x[nodes], self.x[np.maximum(ids, 0)])
            sims[ids < 0] = -np.inf
            sims[:, width:][dup] = -np.inf
            for s in range(0, len(nodes), TOGETHER):
                self.levels[k][nodes[s: s + TOGETHER]] = self.choose(ids[s: s + TOGETHER], sims[s: s + TOGETHER], width)

    def walk(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of level k for each row of q, in lock-step: ids and similarities (rows, beam), best first."""
        n, rows = len(self.x), np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        sims, done = np.full((len(q), beam), -np.inf, np.float32), np.zeros((len(q), beam), bool)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("qd,qd->q", q, self.x[start[:, 0]])
        seen = np.zeros((len(q), n), bool)
        seen[rows, start[:, 0]] = True
        links = self.levels[k]
        while len(rows):
            open_ = np.where(done[rows] | (ids[rows] < 0), -np.inf, sims[rows])
            top = np.argsort(-open_, axis=1, kind="stable")[:, :EXPAND]
            live = np.isfinite(np.take_along_axis(open_, top, 1))
            going = live.any(1)
            rows, top, live = rows[going], top[going], live[going]
            if not len(rows):
                break
            r = rows[:, None]
            done[r, top] |= live
            near = links[np.where(live, ids[r, top], 0)]
            near = np.where(live[..., None], near, -1).reshape(len(rows), -1).astype(np.int64)
            fresh = (near >= 0) & ~seen[r, np.maximum(near, 0)]
            # one node may be reached over several of the expanded ones: keep its first place
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~again
            seen[np.broadcast_to(r, near.shape)[fresh], near[fresh]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            a, b = np.nonzero(fresh)
            s[a, b] = np.einsum("ed,ed->e", q[rows[a]], self.x[near[a, b]])
            all_ids, all_sims = np.concatenate([ids[rows], near], 1), np.concatenate([sims[rows], s], 1)
            all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows], sims[rows], done[rows] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_done))
            ids[rows] = np.where(np.isfinite(sims[rows]), ids[rows], -1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for k in range(len(self.levels) - 1, 0, -1):
            start = self.walk(q, start, k, EXPAND)[0][:, :1]
        return self.walk(q, start, 0, beam)


def scan(q: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact pairs (row of q, row of x) with similarity of at least ``least``, a block of rows at a time."""
    for s in range(0, len(q), TOGETHER):
        i, j = np.nonzero(q[s: s + TOGETHER] @ x.T >= least)
        yield i + s, j


def within(graph: Graph, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, node) of similarity ``least`` or more, and the crowded rows: those whose beam is full of such
    nodes, left to an exact scan. The beam widens until an audit of evenly spaced rows against an exact scan finds RECALL
    of the pairs, and as many of evenly spaced nodes are found from copies turned to similarity ``least``, so the audit is
    never empty; where the widest beam fails, every row counts as crowded."""
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    n = len(graph.x)
    truth = np.concatenate([audit[i] * np.int64(n) + j for i, j in scan(q[audit], graph.x, least)])
    nodes = np.repeat(np.unique(np.linspace(0, n - 1, min(COPIES, n)).astype(int)), COPIES_EACH)
    away = np.random.default_rng(5).standard_normal((len(nodes), graph.x.shape[1]))
    away -= np.einsum("nd,nd->n", away, graph.x[nodes])[:, None] * graph.x[nodes]
    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-30)
    near = min(max(least, 0.0), 1.0)
    copies = (near * graph.x[nodes] + math.sqrt(1 - near * near) * away).astype(np.float32)
    copies /= np.maximum(np.sqrt((copies * copies).sum(1, keepdims=True)), 1e-30)
    to_node = np.einsum("nd,nd->n", copies, graph.x[nodes])
    beam = BEAM
    while beam <= WIDEST:
        met = 0
        for s in range(0, len(copies), TOGETHER):
            ids, sims = graph.search(copies[s: s + TOGETHER], beam)
            # a beam full of nodes as near as the planted one would be scanned
            met += ((ids == nodes[s: s + TOGETHER, None]).any(1) | (sims[:, -1] >= to_node[s: s + TOGETHER] - 1e-6)).sum()
        if met < RECALL * len(copies):
            beam *= 2
            continue
        found_i, found_j, full = [], [], []
        for s in range(0, len(q), TOGETHER):
            ids, sims = graph.search(q[s: s + TOGETHER], beam)
            hit = sims >= least
            crowded = hit[:, -1]
            full.append(np.flatnonzero(crowded) + s)
            i, j = np.nonzero(hit & ~crowded[:, None])
            found_i.append(i + s)
            found_j.append(ids[i, j])
        i, j, rest = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(full)
        due = truth[~np.isin(truth // n, rest)]
        if np.isin(due, i * np.int64(n) + j).sum() >= RECALL * len(due):
            return i, j, rest
        beam *= 2
    return np.zeros(0, int), np.zeros(0, int), np.arange(len(q))


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that neither huge nor tiny components overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _dump(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard as one row."""
    rows = rows.sort_values("node")
    v = _unit(np.array(rows["v"].tolist(), np.float64))
    g = Graph(v)
    blob = _dump(v=v, node=rows["node"].to_numpy(), n=rows["n"].to_numpy(), entry=np.array(g.entry), **{f"l{k}": x for k, x in enumerate(g.levels)})
    return pd.DataFrame({k: [rows[k].iloc[0]] for k in ("label", "dim", "shard", "shards")} | {"graph": [blob]})


def match(a: bytes, b: bytes | None, threshold: float) -> pd.DataFrame:
    """Links between the vectors of shard a and shard b (None: within a): per node its number of linked vectors and the
    node its set hangs on; sets are those of this pair of shards."""
    qa = np.load(io.BytesIO(a))
    qb = qa if b is None else np.load(io.BytesIO(b))
    levels = [qb[f"l{k}"] for k in range(sum(x.startswith("l") for x in qb.files))]
    va, vb = qa["v"], qb["v"]
    fa, fb = va.astype(np.float32), vb.astype(np.float32)
    least = threshold - 1e-4
    i, j, crowded = within(Graph(fb, levels, int(qb["entry"])), fa, least)
    own = b is None
    shift = 0 if own else len(va)
    node, weight = (qa["node"], qa["n"]) if own else (np.concatenate([qa["node"], qb["node"]]), np.concatenate([qa["n"], qb["n"]]))
    links, parent = np.zeros(len(node)), np.arange(len(node))

    def sure(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that hold in double precision."""
        ok = np.concatenate([np.einsum("ed,ed->e", va[i[s: s + 65536]], vb[j[s: s + 65536]]) >= threshold for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        return i[ok], j[ok]

    scanned = np.zeros(len(va), bool)
    scanned[crowded] = True
    if own:  # a pair found from either side counts once; pairs with a crowded row come from its scan
        i, j = np.minimum(i, j), np.maximum(i, j)
        code = np.unique((i * np.int64(len(vb)) + j)[(i != j) & ~scanned[i] & ~scanned[j]])
        i, j = code // len(vb), code % len(vb)
    i, j = sure(i, j)
    links += np.bincount(i, weight[j + shift], len(node)) + np.bincount(j + shift, weight[i], len(node))
    unite(parent, i, j + shift)
    for i, j in scan(fa[crowded], fb, least):
        i = crowded[i]
        if own:
            i, j = i[i != j], j[i != j]
        i, j = sure(i, j)
        links += np.bincount(i, weight[j + shift], len(node))
        back = ~scanned[j] if own else np.ones(len(j), bool)  # two crowded rows each count the other themselves
        links += np.bincount(j[back] + shift, weight[i[back]], len(node))
        unite(parent, i, j + shift)
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[parent[some]]})


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors are compared only within one label and dimension. Rows with a null label, a null, empty or zero vector or a
    null or non-finite component link with nothing. Equal vectors are collapsed first and counted as links of each other.
    component_id: smallest vec_id reachable (a null id names nothing: null where only such rows are in reach);
    kept: vec_id = component_id, null-safe. Empty table: empty result. Links are found by search, then verified in double
    precision: none below the threshold, and those missed are what an audited recall of RECALL per shard leaves.
    """
    bounded_batches(df.sparkSession)
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    clean = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(clean, F.sha2(F.concat_ws(",", F.col("label").cast("string"), v.cast("array<string>")), 256)))
    groups = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = checkpointed(groups.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    sizes = groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    x = groups.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    kind = dict(groups.dtypes)["label"]
    graphs = x.select("label", "dim", "shard", "shards", "node", "n", "v").groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, shards int, graph binary")
    graphs = checkpointed(graphs)
    # every shard meets every other one of its label once; the pair is part of the key, so large labels spread
    left = graphs.withColumn("other", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))).select("label", "dim", F.col("shard").alias("i"), F.col("other").alias("j"), F.col("graph").alias("a"))
    right = graphs.filter("shard > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shard") - 1))).select("label", "dim", F.col("other").alias("i"), F.col("shard").alias("j"), F.col("graph").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b in zip(f["a"], f["b"]):
                yield match(a, b, threshold)

    found = left.join(right, ["label", "dim", "i", "j"], "left").select("a", "b").mapInPandas(run, "node long, links long, root long")
    found = checkpointed(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "c_node")
    named = groups.select("key", "low", "n", "node").join(counts, "node", "left").join(comp, F.col("node") == F.col("c_node"), "left")
    named = named.withColumn("c", F.coalesce("component", "node"))
    first = named.groupBy("c").agg(F.min("low").alias("component_id"))
    info = named.join(first, "c").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(info, "key", "left")
    comp_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))


#: Brute force: all pairs of a label, components as the smallest id over all reachable ones.
TWIN = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {THRESHOLD} ELSE false END),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) r ON r.vec_id = e.vec_id
"""
