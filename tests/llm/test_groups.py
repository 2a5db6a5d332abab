"""Near-duplicates, packing, mixing and the pipeline against brute force."""
import bisect
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import common, hnsw, mixing, packing, simhash, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 800)]
    want = roots(800, pairs)
    df = spark.createDataFrame(pairs + pairs[:9] + [(3, 3), (None, 4)], "a long, b long")
    got = {x["node"]: x["component"] for x in common.components(df).collect()}
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in touched}
    assert common.components(df.filter("false")).count() == 0


def test_bounded_sample(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("c"), "id")
    got = common.sample_per_class(df, "c", F.col("id"), 5).collect()
    assert sorted((x["c"], x["id"]) for x in got) == [("a", i) for i in range(5)] + [("b", i) for i in range(900, 905)]


def test_a_hot_class_is_cut_in_shares_first(spark):
    df = spark.range(0, 20000, 1, 16).select(F.when(F.col("id") % 9 > 0, "a").otherwise("b").alias("c"), "id")
    plan = common.sample_per_class(df, "c", F.col("id"), 5)._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert len(moves) == 2 and "__s" in moves[1] and "__s" not in moves[0]


# ---------------------------------------------------------------- SimHash
def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < k else [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed=4, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(30, 300))]
        texts.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 6])):
            copy = words[:]
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
    return texts + ["", None, " \n", "One", "one", "É a b c d", texts[0].upper(), "x y z"]


def test_fingerprints():
    for t in near_texts() + ["a\x0bb c\x1cd e", "q" * 100, "ß Ä b c D"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
        assert simhash.fingerprint(t, 5) == plain_fingerprint(t, 5)


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    texts = near_texts()
    fp = [plain_fingerprint(t) for t in texts]
    n = len(fp)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4])
    assert len(set(want)) < n - 20
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, budget=4: real(d, budget, chunk))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in range(n)}


def test_large_dense_group_is_whole(spark):
    base, rng = 0x123456789ABCDEF0, random.Random(2)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(900)} | {base ^ (0xFFFFFFFF << 20)})
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    edges = simhash.links(df, 4, 100)
    assert edges.count() < 40 * len(fps)  # no pairs within the group
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("halves", [False, True])
def test_sets_join_equals_all_pairs(halves):
    """One hot group: a passage in every set, copies of one set with changes, sets on their own."""
    r = random.Random(3)
    passage = list(range(40))
    sets = [r.sample(range(100, 10**6), r.randrange(1, 60)) + passage[: r.randrange(41)] for _ in range(150)]
    base = r.sample(range(10**6, 10**7), 50)
    sets += [[x for x in base if r.random() > 0.08] + r.sample(range(10**7, 10**8), r.randrange(6)) + passage[: r.choice([0, 40])] for _ in range(150)]
    sets = [np.unique(np.array(x, np.uint64)) for x in sets]
    half = np.array([r.random() < 0.5 for _ in sets])
    exact = [set(x.tolist()) for x in sets]
    near = [(i, j) for i in range(300) for j in range(i) if 5 * len(exact[i] & exact[j]) >= 4 * len(exact[i] | exact[j]) and (not halves or half[i] != half[j])]
    got = simhash.join_sets(sets, 0.8, half if halves else None)
    assert roots(300, got) == roots(300, near) and len(got) == 300 - len(set(roots(300, near))) and len(near) > 1000
    assert simhash.join_sets([], 0.8) == [] and simhash.join_sets([sets[0]], 0.8) == []


@pytest.mark.parametrize("family", [simhash.FAMILY, 400])
def test_stage_drops_copies_by_shingle_similarity(spark, monkeypatch, family):
    monkeypatch.setattr(simhash, "FAMILY", family)
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = ["", None, "one two", "two one"]
    for size in (12, 60, 200):
        for n in (2, 3, 30):
            base = [r.choice(vocab) for _ in range(size)]
            for _ in range(n):
                at = r.randrange(size)
                texts.append(" ".join(base[:at] + [r.choice(vocab) for _ in range(r.randint(0, size // 12))] + base[at:]))
    sets = [frozenset(" ".join(w[i: i + 5]) for i in range(max(1, len(w) - 4))) for w in [(t or "").split() for t in texts]]
    fp = [plain_fingerprint(t, 5) for t in texts]
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
    alike = [(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = roots(n, near + alike)
    assert len(set(want)) < len(set(roots(n, near))) - 20
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(texts)], DOC)
    assert sorted(x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == sorted(set(want))


def test_odd_documents(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "only this one here", "x"), (9, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("5", "5"), ("5", "5"), ("8", "8"), ("9", "8"), ("None", "5"), ("None", "None")]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "8", "None"]
    assert simhash.near_duplicates(df.filter("false")).count() == 0


# ---------------------------------------------------------------- embeddings
def brute_links(rows):
    """rows: (vec_id, vector, label)."""
    def usable(v, lab):
        return lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links, pairs = len(rows), [0] * len(rows), []
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and usable(a, la) and usable(b, lb) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    return links, roots(n, pairs)


@pytest.mark.parametrize("shard", [hnsw.SHARD, 60])
def test_embedding_links_equal_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    vecs = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            vecs.append(((base + rng.standard_normal(16) * rng.choice([0, 0.01, 0.05, 0.08])).astype("f4").tolist(), int(c % 3)))
    crowd = rng.standard_normal(16)
    vecs += [((crowd + rng.standard_normal(16) * 0.02).astype("f4").tolist(), 1) for _ in range(120)]
    vecs += [([0.0] * 16, 1), (None, 1), (vecs[0][0], None), ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([], 1), ([float("inf")] + [1.0] * 15, 1), ([3.0] * 8, 1), (vecs[0][0], vecs[0][1]), ([1e-30] * 16, 2), ([2e-30] * 16, 2)]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(vecs)]
    links, comp = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x"))
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, shard=shard).collect()}
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(len(rows))] == links
    assert [got[i]["component_id"] for i in range(len(rows))] == comp and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert hnsw.near_duplicates(df.filter("false")).count() == 0


def test_search_recall_and_repeated_ids(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    x[1500:] = x[:1500] + rng.standard_normal((1500, 32)) * 0.02
    x = hnsw._unit(x)
    g = hnsw.Graph(x)
    i, j, crowded = hnsw.within(g, x.astype("f4"), 0.98)
    a, b = (np.concatenate(v) for v in zip(*hnsw.scan(x.astype("f4"), g.x, 0.98)))
    assert len(np.unique(i * 3000 + j)) >= 0.99 * len(a) and not len(crowded)
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]


def test_two_shards_with_sparse_pairs():
    rng = np.random.default_rng(1)
    a, b = hnsw._unit(rng.standard_normal((1500, 32))), hnsw._unit(rng.standard_normal((1500, 32)))
    own = np.setdiff1d(np.arange(0, 1500, 20), np.linspace(0, 1499, hnsw.AUDIT).astype(int))  # none is an audited row
    a[own] = hnsw._unit(b[own] + rng.standard_normal((len(own), 32)) * 0.01)
    g = hnsw.Graph(b)
    for level in g.levels:  # a graph that has lost its links to a third of the nodes
        level[(level >= 0) & (level % 3 == 0)] = -1
    i, j, rest = hnsw.within(g, a.astype("f4"), 0.98 - 1e-4)
    got = set(zip(i.tolist(), j.tolist())) | {(x, x) for x in rest.tolist()}
    assert {(x, x) for x in own.tolist()} <= got


# ---------------------------------------------------------------- packing
@pytest.mark.parametrize("kind", ["mixed", "tiny", "same", "large"])
def test_packing(spark, kind):
    r = random.Random(7)
    lengths = {"mixed": [min(100, int(r.expovariate(1 / 30)) + 1) for _ in range(600)], "tiny": [r.randint(1, 4) for _ in range(900)], "same": [34] * 301, "large": [r.randint(51, 100) for _ in range(80)]}[kind]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length int").withColumn("offset", F.lit("x"))
    got = packing.pack(df, "length", 100).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got["doc_id"]) == list(range(len(lengths)))
    for _, g in got.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 100
    gaps, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            left = gaps.pop(i) - x
        else:
            bins += 1
            left = 100 - x
        if left:
            bisect.insort(gaps, left)
    assert got["sequence_id"].nunique() <= 1.03 * bins + 1


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, 0), (4, 101), (5, 100), (None, 7)], "doc_id long, length int")
    got = packing.pack(df, "length", 100).collect()
    assert len(got) == 7 and sum(r["sequence_id"] is None for r in got) == 3
    assert packing.pack(df.filter("false"), "length", 100).count() == 0
    assert packing.pack(df.filter("length = 100"), "length", 100).count() == 1


def test_pieces_round_trip(spark):
    enc = tokens.encoder(tokens.default_path())
    texts = ["", None, "hello world", "abc " * 900, "same", "same", "x y z " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [*enc.encode(t or "").tolist(), 2]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        assert all(r["length"] == 1024 for r in own[1:]) and (len(own) == 1 or len(ids) > 1024)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in own)
    assert packing.pack_documents(df.filter("false")).count() == 0


def test_sweep_takes_the_tightest_slot():
    runs = packing.sweep({5: (0, 2), 3: (0, 2)}, {6: 1, 4: 1, 9: 1})
    assert runs == [(5, 0, 1, 6, 0), (5, 1, 2, 9, 0), (3, 0, 1, 4, 0)]


# ---------------------------------------------------------------- mixing
def skewed(spark, extra=()):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), "en", f"s{0 if r.random() < 0.6 else r.randint(1, 12)}", 0) for i in range(700)]
    return spark.createDataFrame([*rows, *extra], DOC)


def test_mixing_equals_sql(spark):
    docs = skewed(spark, [(2000, "a b c", "en", None, 0), (2001, None, "en", "s1", 0), (None, "x y", "en", "s2", 0), (2002, "q " * 50, "en", "tiny", 0), (2003, "", "en", "empty", 0)])
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.TWIN).fetchall()
    got = [tuple(r) for r in mixing.mix_documents(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} != {0} and len(got) != docs.count()


def test_mixing_reaches_its_target(spark):
    docs = skewed(spark)
    p = mixing.plan(docs, max_epochs=100.0).toPandas()
    w = p["weight"].to_numpy()
    assert -(w * np.log(w)).sum() / np.log(len(w)) == pytest.approx(0.9, abs=1e-4)
    got = mixing.mix_documents(docs).groupBy("source").agg(F.sum("n_words").alias("n")).toPandas().set_index("source")["n"]
    q = mixing.plan(docs).toPandas().set_index("source").loc[got.index]
    assert (got <= q["quota"]).all() and (got >= q["quota"] - 40).all() and (q["quota"] <= 2 * q["tokens"]).all()


def test_mixing_odd_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (2, None, "en", "t", 0)], DOC)
    assert sorted(r["doc_id"] for r in mixing.mix_documents(one).collect()) == [1, 1]
    plan = mixing.mix(one, mixing.plan(one))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_replaces_clashing_columns(spark):
    docs = skewed(spark).withColumns({"epoch": F.lit("x"), "at": F.lit("y"), "weight": F.lit("z"), "tokens": F.lit(1), "n": F.lit(2)})
    plan = mixing.plan(docs)
    got = mixing.mix(docs, plan)
    assert sorted(got.columns) == sorted([*docs.columns])
    plain = mixing.mix(skewed(spark), mixing.plan(skewed(spark)))
    cols = ["doc_id", "source", "epoch", "at", "weight"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))
    assert {(r["tokens"], r["n"]) for r in got.select("tokens", "n").distinct().collect()} == {(1, 2)}


# ---------------------------------------------------------------- pipeline
@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with planted cases."""
    d = str(tmp_path_factory.mktemp("docs"))
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(300)]
    text = lambda n: ". ".join(" ".join(r.choice(vocab) for _ in range(8)).capitalize() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(500):
        kind = "junk" if i % 7 == 0 else "toxic" if i % 5 == 0 else "fine"
        t = "### $$$ | " * 60 if kind == "junk" else text(r.randint(4, 30))
        if kind == "toxic":
            w = t.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
            t = " ".join(w)
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(1, 60)]
    rows += [(None, text(5), None, None, None), (2000, None, "en", "s1", None), (2001, "", "en", "s1", 0), (3, rows[3][1], "en", "s3", rows[3][4])]
    spark.createDataFrame(rows, DOC).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [r["doc_id"] for r in docs.collect()]
    kind = lambda i: "junk" if i % 7 == 0 else "toxic" if i % 5 == 0 else "fine"
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in out[name] if r["doc_id"] is not None and r["doc_id"] < 500]
    assert set(ids("quality")) == {i for i in range(500) if kind(i) != "junk"} and len(before) > len(out["quality"])
    fine = {i for i in range(500) if kind(i) == "fine"}
    assert set(ids("toxicity")) <= fine | {i for i in range(500) if kind(i) == "toxic"} and len(set(ids("toxicity")) - fine) <= 3 and fine <= set(ids("toxicity"))
    assert len(ids("simhash_dedup")) == len(set(ids("simhash_dedup"))) and not [r for r in out["simhash_dedup"] if 1000 < (r["doc_id"] or 0) < 1100]
    groups = {plain_fingerprint(r["text"], 5) for r in out["simhash_dedup"]}
    assert len(groups) == len(out["simhash_dedup"])
    assert set(ids("source_mixing")) <= set(ids("simhash_dedup"))
    total = {}
    for r in out["packing"]:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    enc = tokens.encoder(tokens.default_path())
    assert max(total.values()) <= 1024 and sum(total.values()) == sum(len(enc.encode(r["text"] or "")) + 1 for r in out["source_mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(out["packing"])


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py" and toxicity.ACCEPT == 0.7
