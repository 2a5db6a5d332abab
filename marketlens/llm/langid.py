"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import id_remainder, sample_per_class, with_text_column

HIDDEN = 12
#: Positions the network reads before it starts afresh: a text is cut into runs of this many bytes, all of them read.
RUN = 256
#: Runs processed in lock-step.
LANES = 1024
#: Training sample: pieces of PIECE characters, at most PER_LANG for each language.
PER_LANG, PIECE, STEPS = 400, 160, 260


def has_letter(text: str) -> bool:
    """Whether a text holds a letter (Unicode category L): digits, fractions, Roman or circled numerals are none."""
    return any(map(str.isalpha, text))


class LangModel:
    """languages, byte tables (256, 3, H) and recurrent weights of both directions, output weights (2H, K), bias (K)."""

    def __init__(self, langs: list[str], p: dict[str, np.ndarray]):
        self.langs, self.p = langs, p
        self.fwd = tuple(np.ascontiguousarray(p["ef"][:, k]) for k in range(3)), p["uf"]
        self.bwd = tuple(np.ascontiguousarray(p["eb"][:, k]) for k in range(3)), p["ub"]

    def pooled(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean class probability over all positions of each text, and how many positions each class labels."""
        k = len(self.langs)
        total, votes = np.zeros((len(data), k)), np.zeros((len(data), k), np.int64)
        starts = [(i, s) for i, d in enumerate(data) for s in range(0, len(d), RUN)]
        starts.sort(key=lambda x: min(RUN, len(data[x[0]]) - x[1]), reverse=True)
        wf, wb, bias = (np.ascontiguousarray(x.T) for x in (self.p["w"][:HIDDEN], self.p["w"][HIDDEN:], self.p["b"][None]))
        for at in range(0, len(starts), LANES):
            part = starts[at: at + LANES]
            owner = np.array([i for i, _ in part])
            lengths = np.array([min(RUN, len(data[i]) - s) for i, s in part])
            t_max = int(lengths[0])
            block = b"".join(data[i][s: s + t_max].ljust(t_max, b"\0") for i, s in part)
            ids = np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(len(part), t_max).T)
            prob, vote = np.zeros((k, len(part)), np.float32), np.zeros((k, len(part)), np.int32)

            def visit(t: int, n: int, hf: np.ndarray, hb: np.ndarray, prob=prob, vote=vote) -> None:
                y = wf @ hf.T
                y += wb @ hb.T
                y += bias
                vote[:, :n] += y == y.max(0)
                np.exp(y, out=y)  # bounded: states lie in (-1, 1)
                y /= y.sum(0)
                prob[:, :n] += y

            gru.run(ids, lengths, self.fwd, self.bwd, visit)
            np.add.at(total, owner, prob.T)
            np.add.at(votes, owner, vote.T)
        size = np.array([max(1, len(d)) for d in data])[:, None]
        return total / size, votes


def train(pieces: list[tuple[str, str]], seed: int = 7) -> LangModel:
    """Fit on (lang, text) pieces by backpropagation through time; every byte position is labelled with the text's
    language. The order of ``pieces`` does not matter. No pieces: a model without languages."""
    pieces = sorted(pieces)
    langs = sorted({x for x, _ in pieces})
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, max(1, len(langs))
    p = {"ef": rng.standard_normal((256, 3, h)) * 0.4, "eb": rng.standard_normal((256, 3, h)) * 0.4,
         "w": rng.standard_normal((2 * h, k)) * 0.2, "b": np.zeros(k)}
    p = {x: v.astype(np.float32) for x, v in p.items()} | {"uf": gru.init(rng, h), "ub": gru.init(rng, h)}
    if len(langs) < 2:
        return LangModel(langs, p)
    y_all = np.array([langs.index(x) for x, _ in pieces])
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for _, t in pieces]
    by_class = [np.flatnonzero(y_all == c) for c in range(k)]
    adam, lanes = gru.Adam(p, 0.02), 128
    for step in range(STEPS):
        pick = np.concatenate([rng.choice(c, max(1, lanes // k)) for c in by_class])
        t_max = int(rng.integers(12, 64))
        ids, mask = np.zeros((t_max, len(pick)), np.uint8), np.zeros((t_max, len(pick), 1), np.float32)
        for j, i in enumerate(pick):
            s = rng.integers(0, max(1, len(data[i]) - t_max + 1))
            d = data[i][s: s + t_max]
            ids[: len(d), j], mask[: len(d), j, 0] = d, 1
        hf, tf = gru.forward(p["ef"][ids], mask, p["uf"])
        hb, tb = gru.forward(p["eb"][ids[::-1]], mask[::-1], p["ub"])
        both = np.concatenate([hf, hb[::-1]], 2)
        z = both @ p["w"] + p["b"]
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        e /= e.sum(2, keepdims=True)
        e[:, np.arange(len(pick)), y_all[pick]] -= 1
        e *= mask / mask.sum()
        d_both = e @ p["w"].T
        da_f, du_f = gru.backward(d_both[..., :h], mask, p["uf"], tf)
        da_b, du_b = gru.backward(np.ascontiguousarray(d_both[::-1, :, h:]), mask[::-1], p["ub"], tb)
        g = {"w": np.einsum("tbh,tbk->hk", both, e), "b": e.sum((0, 1)), "uf": du_f, "ub": du_b, "ef": np.zeros_like(p["ef"]), "eb": np.zeros_like(p["eb"])}
        np.add.at(g["ef"], ids, da_f)
        np.add.at(g["eb"], ids[::-1], da_b)
        adam.step(g, 1.0 if step < STEPS * 0.6 else 0.3)
    return LangModel(langs, p)


def training_pieces(df: DataFrame, text: str, lang: str, order, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most per_lang pieces of PIECE characters for each language, one per text, at a place set by the text's hash:
    the bounded sample the network is fitted on (the number of languages bounds its size)."""
    x = df.filter(f"`{lang}` IS NOT NULL AND `{text}` IS NOT NULL").filter(F.length(text) > 0).select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("o"))
    n = F.length("text")
    x = x.select("lang", "o", F.substring("text", (1 + F.pmod(F.col("o"), F.greatest(n - PIECE, F.lit(1)))).cast("int"), F.lit(PIECE)).alias("piece"))
    return [(r["lang"], r["piece"]) for r in sample_per_class(x, "lang", F.struct("o", "piece"), per_lang).select("lang", "piece").collect()]


def identify(df: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (pooled probability of that language, 0 to 1), n_positions (labelled byte
    positions) and agree (share of positions with that label).

    Null texts and texts without a letter: ``und``, score 0. Whole texts are read, however long. Equal texts get
    equal results; columns of ``df`` by the four names are replaced. With one learned language it is always given.
    """
    def make():
        def f(texts: list) -> dict:
            ok = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if model.langs else []
            data = [texts[i].encode("utf-8", "replace") for i in ok]
            out = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "n_positions": [len((t or "").encode("utf-8", "replace")) for t in texts], "agree": [0.0] * len(texts)}
            if data:
                prob, votes = model.pooled(data)
                best = prob.argmax(1)
                for j, i in enumerate(ok):
                    c = best[j]
                    out["lang_pred"][i], out["score"][i] = model.langs[c], float(min(1.0, prob[j, c]))
                    out["agree"][i] = float(votes[j, c] / len(data[j]))
            return out
        return f

    return with_text_column(df, text, make, "lang_pred string, score double, n_positions long, agree double")


def predict_documents(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Fit on the documents that are not held out (crc32 of the id modulo 4 is not 2) and label every document.

    A row with a null id is labelled but not learned from: it counts as held out. Null texts and null languages teach
    nothing; repeated rows are learned and labelled like others; no rows: no result."""
    seen = F.coalesce(id_remainder(doc_id, 4) != 2, F.lit(False))
    pieces = training_pieces(docs.filter(seen), text, lang, F.xxhash64(doc_id, text))
    model = train(pieces)
    out = identify(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "n_positions", "agree")
