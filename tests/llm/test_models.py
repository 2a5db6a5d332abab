"""Learned operators: held-out accuracy on the given documents, defined results for odd input."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import gru, langid, quality, toxicity
from marketlens.llm.common import id_remainder

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string"
ODD = [(1, None, "en", "s", 0, "x", "y"), (2, "", None, None, None, "x", "y"), (3, "12 %% 34", "de", "s", 8, "x", "y"), (None, "the of and", "en", None, 10, None, None),
       (5, "word " * 30_000, "fr", "s", 1, "x", "y"), (6, "the of and the", "en", "s", 1, "x", "y"), (6, "the of and the", "en", "s", 1, "x", "y"), (7, "😀 ñandú", "es", "s", 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    a, u = rng.standard_normal((5, 3, 3, 4)).astype("f4"), gru.init(rng, 4)
    mask = np.ones((5, 3, 1), "f4")
    mask[3:, 1] = 0
    w = rng.standard_normal((5, 3, 4)).astype("f4")
    states, tape = gru.forward(a, mask, u)
    da, du = gru.backward(w, mask, u, tape)
    loss = lambda a, u: float((gru.forward(a, mask, u)[0] * w).sum())
    for arr, grad, at in ((a, da, (2, 1, 0, 3)), (a, da, (0, 0, 2, 1)), (u, du, (1, 2, 3)), (u, du, (2, 0, 1))):
        lo, hi = arr.copy(), arr.copy()
        lo[at] -= 1e-2
        hi[at] += 1e-2
        num = (loss(hi, u) - loss(lo, u)) / 2e-2 if arr is a else (loss(a, hi) - loss(a, lo)) / 2e-2
        assert num == pytest.approx(float(grad[at]), abs=3e-2)


def test_lock_step_equals_training_forward():
    rng = np.random.default_rng(1)
    tab, u = rng.standard_normal((9, 3, 4)).astype("f4"), gru.init(rng, 4)
    lengths = np.array([6, 6, 3, 1])
    ids = rng.integers(0, 9, (6, 4))
    mask = (np.arange(6)[:, None] < lengths)[..., None].astype("f4")
    f, _ = gru.forward(tab[ids], mask, u)
    b, _ = gru.forward(tab[ids[::-1]], mask[::-1], u)
    seen = {}
    side = tuple(np.ascontiguousarray(tab[:, k]) for k in range(3)), u
    gru.run(ids, lengths, side, side, lambda t, n, hf, hb: seen.update({t: (n, hf.copy(), hb.copy())}))
    for t, (n, hf, hb) in seen.items():
        assert n == (lengths > t).sum()
        np.testing.assert_allclose(hf, f[t, :n], atol=1e-5)
        np.testing.assert_allclose(hb, b[::-1][t, :n], atol=1e-5)


def test_language_held_out_accuracy(docs):
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND length(lang) > 0").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert set(got["held_out"]) == {True}


def test_language_of_odd_rows(spark, docs):
    model = langid.train(langid.training_pieces(docs, "text", "lang", F.xxhash64("doc_id"), 30))
    out = langid.identify(spark.createDataFrame(ODD, DOC).drop("predicted"), model).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD) and [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[7]["lang_pred"] != "und"
    assert by[5]["n_positions"] == 150_000 and all(0 <= r["score"] <= 1 for r in out)
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 6}) == 1
    empty = langid.predict_documents(spark.createDataFrame([], DOC))
    assert empty.count() == 0
    none = langid.predict_documents(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und"


def test_language_ignores_held_out_labels(spark, docs):
    twisted = docs.limit(300).withColumn("lang", F.when(id_remainder("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    assert langid.predict_documents(twisted).filter("lang_pred = 'xx'").count() == 0


def test_numerals_and_fractions_are_no_letters(spark, docs):
    model = langid.train([("en", "the cat and the hat " * 8), ("de", "der hund und die katze " * 8)])
    texts = ["½ ²", "① Ⅷ 12", "ª", "x²", "漢", None, ""]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(7)] == [True, True, False, False, False, True, True]


def test_a_row_without_id_teaches_no_language(spark, docs):
    odd = spark.createDataFrame([(None, "zz qq xx " * 40, "zz", "s", 1)] * 30, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.predict_documents(docs.limit(200).unionByName(odd)).where("doc_id IS NULL").collect()
    assert len(got) == 30 and all(r["lang_pred"] != "zz" and r["held_out"] for r in got)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-4]}0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predict_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["quality"]).mean() > 0.97
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_quality_equals_a_plain_ridge_fit(spark):
    """Sums over partitions and their solution against one least-squares fit of all rows with the penalty as further rows."""
    rng = np.random.default_rng(4)
    stats = rng.standard_normal((400, quality.STATS)) * rng.uniform(0.5, 3, quality.STATS)
    y = (stats[:, 0] + 0.3 * rng.standard_normal(400) > 0).astype(float)
    rows = spark.createDataFrame([(x.tolist(), float(v)) for x, v in zip(stats, y)], "stats array<double>, y double").repartition(5)
    model = quality.fit(rows)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, stats.std(0))
    z = model.expand(stats)
    d = z.shape[1]
    penalty = np.sqrt(quality.RIDGE * len(y) / d) * np.eye(d)
    plain = np.linalg.lstsq(np.vstack([z, penalty]), np.append(y, np.zeros(d)), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ plain, atol=1e-6)


def test_quality_of_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD, DOC)
    out = quality.predict_documents(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.predict_documents(spark.createDataFrame([], DOC), labels).count() == 0
    none = quality.predict_documents(odd, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    nulls = labels.withColumns({"quality": F.lit(None).cast("int")})
    assert {r["score"] for r in quality.predict_documents(odd, nulls).collect()} == {0.5}


def test_isotonic_is_the_least_squares_monotone_fit():
    y, w = np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.array([1.0, 1, 2, 2, 1])
    assert quality.isotonic(np.arange(5), y, w).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]


def test_toxicity_gradients_match_differences():
    """The whole network against central differences; attention pooling against its definition, one window at a time."""
    rng = np.random.default_rng(3)
    model = toxicity.train([(1, "a")])  # one class: start values
    model.p["w"][:], model.p["v"][:], model.p["b"][:] = rng.standard_normal(model.p["w"].shape), rng.standard_normal(model.p["v"].shape), 0.1
    words, chars, counts = toxicity.Pieces(["good", "bad", "ugly", "word", "x"]).take(np.arange(5))
    ids, sizes, y = rng.integers(0, 5, (6, 4)), [6, 3, 1, 5], np.array([1, 0, 1, 0], np.float32)
    mask = np.zeros((6, 4, 1), np.float32)
    for j, n in enumerate(sizes):
        mask[:n, j] = 1

    def loss():
        p = {k: x.astype(np.float64) for k, x in model.p.items()}
        v = model.inputs(words, chars, counts).astype(np.float32)
        gates = model.gates(v)
        total = 0.0
        for j, n in enumerate(sizes):
            own, one = ids[:n, j], np.ones((n, 1, 1), np.float32)
            f = gru.forward(np.stack(gates[:3], 1)[own][:, None], one, model.p["uf"])[0][:, 0].astype(np.float64)
            b = gru.forward(np.stack(gates[3:], 1)[own[::-1]][:, None], one, model.p["ub"])[0][::-1, 0].astype(np.float64)
            both = np.concatenate([f, b], 1)
            e = np.exp(both @ p["v"])
            z = (e / e.sum()) @ both @ p["w"] + p["b"][0]
            total += np.log1p(np.exp(-z if y[j] else z))
        return total / len(sizes)

    grads = toxicity.gradients(model, words, chars, counts, ids, mask, y)
    for name in ("v", "w", "b", "uf", "ub", "wf", "wb", "bf", "bb", "ew", "ec"):
        x, g = model.p[name], grads[name]
        for at in [np.unravel_index(k, x.shape) for k in np.argsort(-np.abs(g), axis=None)[:3]]:
            keep, step = x[at], 2e-2
            x[at] = keep + step
            hi = loss()
            x[at] = keep - step
            lo = loss()
            x[at] = keep
            assert abs((hi - lo) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 2e-4, (name, at)


def test_toxicity_finds_marked_words_in_long_texts(spark):
    rng = np.random.default_rng(0)
    clean = [f"wort{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(clean, n))
    rows = [(0, text(60)) for _ in range(200)]
    for k in range(200):
        w = text(60).split()
        w[rng.integers(60)] = rng.choice(["idiot", "moron", "lowe" + clean[k]])
        rows.append((1, " ".join(w)))
    model = toxicity.train(rows)
    long = text(9000)
    cases = [long, long + " Idiot! " + text(500), text(400) + " lowewort777", "", None, "wort3 " * 500, "idiot " * 3]
    out = toxicity.score_text(spark.createDataFrame([(t, 1) for t in cases], "text string, score int"), model).collect()
    s = [r["score"] for r in out]
    assert s[0] < 0.7 and s[1] >= 0.7 and s[2] >= 0.7 and s[3] == s[4] == 0 and s[5] < 0.7 and s[6] >= 0.7
    assert 8970 <= out[1]["window_start"] <= 9000 and out[3]["window_start"] == -1


def test_windows_cover_every_word():
    for n in range(0, 200):
        seen = {i for s in toxicity.windows(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_toxicity_of_odd_rows(spark, labels):
    odd = spark.createDataFrame(ODD, DOC)
    out = toxicity.predict_documents(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.predict_documents(spark.createDataFrame([], DOC), labels).count() == 0


def test_toxicity_pieces():
    p = toxicity.Pieces(["Idiot!", "idiot", "x", "été,", "été"])
    assert p.words[0] == p.words[1] and p.words[3] == p.words[4] and p.counts.tolist() == [7, 7, 3, 7, 7]
    w, c, n = p.take(np.array([1, 0]))
    assert c[:7].tolist() == c[7:].tolist() and n.tolist() == [7, 7] and w[0] == w[1]
