"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, checkpointed, components, split_join, with_text_column, written

#: Two fingerprints of 64 bits within BUDGET differing bits agree on one of BUDGET + 1 blocks of bits.
BUDGET = 4
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that meet in one task pair; larger groups are split into chunks, every pair of chunks a task of its own.
CHUNK = 8192
#: Node pairs of at most this many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Leaf pairs held at once, and rows of one trie forest.
SLICE, FOREST = 1 << 20, 1 << 17

#: Sets of shingles of similarity s agree on one of BANDS bands of BAND_ROWS least hashes but for a chance of
#: (1 - s ** BAND_ROWS) ** BANDS: 5e-8 at 0.8.
BANDS, BAND_ROWS = 32, 4
#: Shingles of a family of sets that one task joins; larger families are split into parts that meet pair by pair.
FAMILY = 1 << 21

_byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of every shingle of a text in order; a text of fewer words is one shingle; no words: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit fingerprint: bit set where over half of the shingle hashes have it; no words: zero."""
    return _fold(shingle_hashes(text, shingle))


def _fold(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    data = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([(np.bincount(data[:, 7 - j], minlength=256) @ _byte_bits) for j in range(8)])  # high byte first
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4, into: str = "fp") -> DataFrame:
    """``df`` with a fingerprint (signed long holding the 64 bits). Null and empty texts: 0. Words are split at the ASCII white
    space that ``bytes.split`` knows (0x09-0x0D, 0x20); only A-Z are lower-cased. Equal texts get equal results."""
    def make():
        def f(texts: list) -> dict:
            return {into: np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}
        return f

    return with_text_column(df, text, make, f"{into} long")


_mixers = np.random.default_rng(7).integers(0, 2**64, (BANDS * BAND_ROWS, 2), np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """One number per band for a set of shingle hashes; sets share it where they share the least hashes of that band."""
    least = np.empty(len(_mixers), np.uint64)
    for k, (a, b) in enumerate(_mixers):
        x = (hashes ^ b) * a
        least[k] = ((x ^ (x >> np.uint64(32))) * b).min()
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def with_signature(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """``df`` with fp, and of the set of shingles its hash s (null: no words), size and bands."""
    def make():
        def f(texts: list) -> dict:
            lists = [shingle_hashes(t, shingle) for t in texts]
            sets = [np.unique(x) for x in lists]
            return {"fp": np.array([_fold(x) for x in lists], np.uint64).view(np.int64), "s": [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 if len(x) else None for x in sets],
                    "size": [len(x) for x in sets], "bands": [bands(x) if len(x) else [] for x in sets]}
        return f

    return with_text_column(df, text, make, "fp long, s long, size int, bands array<long>")


def join_sets(sets: list[np.ndarray], least: float, half: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect all pairs of sets (sorted, distinct) of Jaccard similarity ``least`` or more, at most one per set.

    Exact: in the order of how few sets hold an element, two such sets share one of their first n - ceil(least * n) + 1
    elements, so only sets that meet there are compared, and none that are connected already. With ``half``, only sets of
    different halves are compared."""
    size = np.array([len(x) for x in sets])
    if len(sets) < 2:
        return []
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, token, uses = np.unique(every, return_inverse=True, return_counts=True)
    by_size = np.argsort(size, kind="stable")
    turn = np.empty(len(sets), np.int64)
    turn[by_size] = np.arange(len(sets))
    order = np.lexsort((token, uses[token], owner))
    place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
    prefix = order[place < (size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)[owner]]
    prefix = prefix[uses[token[prefix]] > 1]
    at = prefix[np.lexsort((turn[owner[prefix]], token[prefix]))]  # sets that hold a token in front, small ones first
    lists, who = token[at], owner[at]
    first, own = np.searchsorted(lists, lists, "left"), np.arange(len(at))
    mine = [[] for _ in sets]
    for k, (f, w) in enumerate(zip(first.tolist(), who.tolist())):
        if f < k:
            mine[w].append((f, k))
    elements = np.split(token, np.cumsum(size)[:-1])
    label, members, edges = np.arange(len(sets)), [[i] for i in range(len(sets))], []
    for i in by_size.tolist():
        if not mine[i]:
            continue
        near = np.unique(np.concatenate([who[f:k] for f, k in mine[i]]))
        near = near[(size[near] >= least * size[i] - 1e-9) & (near != i)]
        if half is not None:
            near = near[half[near] != half[i]]
        near = near[label[near] != label[i]]
        while len(near):
            j, near = int(near[0]), near[1:]
            both = len(np.intersect1d(elements[i], elements[j], assume_unique=True))
            if both >= least * (size[i] + size[j] - both) - 1e-9:
                edges.append((i, j))
                small, big = sorted((int(label[i]), int(label[j])), key=lambda c: len(members[c]))
                label[members[small]] = big
                members[big] += members[small]
                members[small] = []
                near = near[label[near] != label[i]]
    return edges


def similar(fps: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) of fingerprints that connect all texts whose sets of shingles have a Jaccard similarity of ``least`` or
    more. Bands name the candidates, the whole sets decide. fps: fp, tk, s, size, bands; rows: tk, __t.

    Equal sets are collapsed first. Sets that share a band lie in one family (components over one edge per set and band). A text
    moves once to its family's task, which joins the whole sets and yields at most one edge per set. A family of more than
    FAMILY shingles is split by hash into parts, and every pair of parts is a task of its own."""
    sets = fps.filter("s IS NOT NULL").groupBy("s").agg(F.min(F.struct("fp", "tk")).alias("m"), F.max("fp").alias("hi"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    sets = written(sets.select("s", "m.fp", "m.tk", "hi", "size", "bands"))
    edges = fps.select("s", F.col("fp").alias("b")).join(sets.filter("fp <> hi").select("s", F.col("fp").alias("a")), "s").select("a", "b").distinct()
    live = sets.select("s", F.explode("bands").alias("g"))
    heads = written(live.groupBy("g").agg(F.min("s").alias("head"), F.count("*").alias("n")).filter("n > 1"))
    hot = F.col("n") >= max(2, sets.count() * BANDS // HOT)
    family = components(split_join(live, heads, ["g"], hot).select(F.col("s").alias("a"), F.col("head").alias("b")))
    family = written(family.select(F.col("node").alias("s"), F.col("component").alias("f")).join(sets.select("s", "fp", "tk", "size"), "s"))
    parts = family.groupBy("f").agg(F.ceil(F.sum(F.col("size").cast("long")) / FAMILY).cast("int").alias("parts"), F.count("*").alias("n"))
    wide = F.col("n") >= max(2, family.count() // HOT)
    family = split_join(family, parts, ["f"], wide).withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    texts = rows.join(family.select("tk", "s", "fp", "f", "parts", "part"), "tk").groupBy("s").agg(F.first(F.struct("fp", "f", "parts", "part", "__t")).alias("x")).select("x.*")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    texts = texts.withColumn("o", other).select("fp", "f", "part", "__t", F.least("part", "o").alias("pi"), F.greatest("part", "o").alias("pj"))
    keys = ["f", "pi", "pj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for f, i, j, part, fp, text in zip(*[batch[c].to_pylist() for c in (*keys, "part", "fp", "__t")]):
                if (f, i, j) != now:
                    yield _family(held, least)
                    now, held = (f, i, j), []
                held.append((fp, part != i, np.unique(shingle_hashes(text, shingle))))
        yield _family(held, least)

    bounded_batches(fps.sparkSession)
    found = texts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    return edges.unionByName(found)


def _family(held: list[tuple], least: float) -> pa.RecordBatch:
    half = np.array([h for _, h, _ in held], bool)
    pairs = join_sets([x for _, _, x in held], least, half if half.any() and not half.all() else None)
    return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in pairs], pa.int64()), pa.array([held[j][0] for _, j in pairs], pa.int64())], ["a", "b"])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_join(fp: np.ndarray, frontier: tuple, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fp`` (uint64) within ``budget`` differing bits, found by walking node pairs of tries together.

    A node is a range of rows that share their first ``depth`` bits; within each range rows are sorted. ``frontier``
    holds arrays (a_lo, a_hi, b_lo, b_hi, err): node pairs to start from, err bits apart so far; a pair of a node with
    itself yields each unordered pair once. Children are paired with the differing bit added; pairs beyond the budget
    are cut off with all their leaves.
    """
    todo = [(depth, tuple(np.asarray(x, np.int64) for x in frontier))]
    ones_at: dict[int, np.ndarray] = {}
    while todo:
        d, (al, ah, bl, bh, err) = todo.pop()
        work = (ah - al) * (bh - bl)
        small = (work <= LEAF_PAIRS) | (d >= 64)
        if small.any():
            yield from leaves(fp, al[small], ah[small], bl[small], bh[small], budget)
            big = ~small
            al, ah, bl, bh, err = al[big], ah[big], bl[big], bh[big], err[big]
        if not len(al):
            continue
        if len(al) > SLICE:
            for s in range(0, len(al), SLICE):
                todo.append((d, tuple(x[s: s + SLICE] for x in (al, ah, bl, bh, err))))
            continue
        if d not in ones_at:
            bit = ((fp >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)
            ones_at[d] = np.concatenate([[0], np.cumsum(bit)])
        ones = ones_at[d]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = (al == bl) & (ah == bh)
        other = ~own
        kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
                (am[other], ah[other], bl[other], bm[other], err[other] + 1)]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kids))
        live = (ah > al) & (bh > bl) & (err <= budget)
        todo.append((d + 1, (al[live], ah[live], bl[live], bh[live], err[live])))


def leaves(fp: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of node pairs, compared bit by bit, a bounded number at a time."""
    own = (al == bl) & (ah == bh)
    # one row of a against its range of b
    n_a = ah - al
    row = np.repeat(np.arange(len(al)), n_a)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n_a) - n_a, n_a) + al[row]
    lo, hi = np.where(own[row], i + 1, bl[row]), bh[row]
    n_b = np.maximum(hi - lo, 0)
    ends = np.cumsum(n_b)
    at = 0
    while at < len(n_b):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        k = n_b[at:to]
        a = np.repeat(i[at:to], k)
        b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)
        near = popcount(fp[a] ^ fp[b]) <= budget
        yield a[near], b[near]
        at = to


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b in ``parent`` (each row points to a row not above it); paths stay compressed."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _forest(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Trie self-joins of whole groups (block, value, chunk pair): edges that link each row to the first of its set."""
    width = np.array([w for _, w in BLOCKS])[rows["block"].to_numpy()]
    start = np.array([s for s, _ in BLOCKS], np.uint64)[rows["block"].to_numpy()]
    fp = rows["fp"].to_numpy().view(np.uint64)
    turned = np.where(start == 0, fp, (fp << start) | (fp >> ((np.uint64(64) - start) & np.uint64(63))))
    group = rows.groupby(["block", "value", "ci", "cj"], sort=False).ngroup().to_numpy()
    side = np.where(rows["ci"] == rows["cj"], 0, np.where(rows["chunk"] == rows["ci"], 0, 1))
    order = np.lexsort((turned, side, group))
    turned, node = turned[order], (group * 2 + side)[order]
    cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    lo, hi, name = cut, np.append(cut[1:], len(node)), node[cut]
    own_pair = (rows["ci"] == rows["cj"]).to_numpy()[order][lo]
    depth = width[order][lo]
    parent = np.arange(len(turned))
    by_name = {int(x): k for k, x in enumerate(name)}
    for d in np.unique(depth):
        front = [(lo[k], hi[k], lo[k], hi[k]) for k in np.flatnonzero(own_pair & (depth == d)) if hi[k] - lo[k] > 1]
        for k in np.flatnonzero(~own_pair & (depth == d) & (name % 2 == 0)):
            j = by_name.get(int(name[k]) + 1)
            if j is not None:
                front.append((lo[k], hi[k], lo[j], hi[j]))
        if front:
            al, ah, bl, bh = np.array(front, np.int64).T
            for a, b in trie_join(turned, (al, ah, bl, bh, np.zeros(len(al), np.int64)), int(d), budget):
                unite(parent, a, b)
    rep = rows["rep"].to_numpy()[order]
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return pd.DataFrame({"a": rep[linked], "b": rep[parent[linked]]})


def links(fps: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all rows (fp, rep), fp distinct, within ``budget`` bits of each other: same components
    as all such pairs, but each group yields at most one edge per row. Complete: fingerprints that near agree on one of
    five blocks of bits; a group that shares a block and holds more than ``chunk`` rows is split by hash into chunks
    and every pair of chunks is joined in its own task."""
    bounded_batches(fps.sparkSession)
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", s), 64 - w).alias("value")) for k, (s, w) in enumerate(BLOCKS)]))
    x = fps.select("fp", "rep", block.alias("k")).select("fp", "rep", "k.block", "k.value")
    sizes = x.groupBy("block", "value").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).filter("parts > 1")
    x = x.join(sizes, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = x.withColumn("chunk", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp"), F.col("parts"))).otherwise(0).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = x.withColumn("o", other).select("fp", "rep", "block", "value", "chunk", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"))
    keys = ["block", "value", "ci", "cj"]
    x = x.repartition(*keys).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= FOREST:  # groups are whole except the last: keep it back
                rows = pd.concat(held, ignore_index=True)
                last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield _forest(rows[~last], budget)
                    rows = rows[last]
                held, n = [rows], len(rows)
        if n:
            yield _forest(pd.concat(held, ignore_index=True), budget)

    return x.mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, budget: int = BUDGET, jaccard: float | None = None) -> DataFrame:
    """One row per row of ``df``: (doc_id, fingerprint, component_id).

    fingerprint: 16 hex digits; component_id: smallest id reachable over links of ``budget`` or fewer differing bits and,
    with ``jaccard``, links of that similarity of shingle sets or more.
    Null and empty texts have fingerprint zero and link with it. Repeated rows and equal texts share a component. A row
    with a null id is linked like any other; it only gives its component a name where no row with an id is in reach
    (component_id null). Empty table: empty result.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"))
    if jaccard is None:
        signed = checkpointed(with_fingerprint(rows, "__t", shingle).select("doc_id", "fp"))
    else:
        rows = rows.withColumn("tk", F.xxhash64("__t"))
        signed = checkpointed(with_signature(rows, "__t", shingle).drop("__t"))
    fps = signed.select("doc_id", "fp")
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # nodes are named by a dense place in id order within the data: the id itself, or the fingerprint where there is none
    nodes = distinct.select("fp", F.coalesce("low", F.lit(2**63 - 1)).alias("low"))
    edges = links(nodes.select("fp", F.col("fp").alias("rep")), budget)
    if jaccard is not None:
        edges = edges.unionByName(similar(signed.drop("doc_id"), rows.select("tk", "__t"), shingle, jaccard))
    comp = components(edges)  # names components by fingerprint
    named = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    first = named.groupBy("c").agg(F.min("low").alias("component_id"))
    by_fp = named.join(first, "c").select("fp", F.when(F.col("component_id") < 2**63 - 1, F.col("component_id")).alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row per component: the one whose id names it (of repeated rows with that id, the first by
    content). Rows without an id: the first by content of each component that no id names."""
    groups = near_duplicates(df, text, doc_id, **options)
    keep = groups.filter(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).alias("__k")).distinct()
    named = df.join(keep, F.col(doc_id) == F.col("__k")).drop("__k")
    order = Window.partitionBy(doc_id).orderBy(*[F.col(c).asc_nulls_last() for c in df.columns if c != doc_id])
    named = named.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    bare = with_fingerprint(df.filter(F.col(doc_id).isNull()), text, options.get("shingle", 4), "__fp")
    lone = groups.filter("component_id IS NULL").select(F.conv("fingerprint", 16, -10).cast("long").alias("__fp")).distinct()
    bare = bare.join(lone, "__fp", "left_semi")
    order = Window.partitionBy("__fp").orderBy(*[F.col(c).asc_nulls_last() for c in df.columns if c != doc_id])
    bare = bare.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(*df.columns)
    return named.unionByName(bare)
