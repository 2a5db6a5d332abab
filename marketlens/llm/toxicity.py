"""Toxicity: bidirectional gated recurrent network with attention pooling over overlapping word windows."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import id_remainder, sample_per_class, with_text_column
from .quality import labelled

HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 12
WORD_IDS, CHAR_IDS = 1 << 14, 1 << 13
#: Words of a window and how far the next one starts: every word but the first and last few is read in two windows.
WINDOW, STRIDE = 24, 12
LANES = 1024
#: Distinct words whose inputs a task keeps.
CACHE = 60_000
#: Training sample: at most this many labelled texts of each class, of at most MAX_CHARS characters; rounds of
#: choosing the window that speaks most for the label, and steps in each.
PER_CLASS, MAX_CHARS, ROUNDS, STEPS = 1000, 12_000, 6, 60
#: Share of the negative training windows in which one of their words is repeated throughout: it is no more toxic so.
REPEATED = 0.15
ACCEPT = 0.7

_marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»„“”‘’–—¡¿"
_mix = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Word id and character-piece ids (byte trigrams with both ends marked, starts and ends of five bytes) of tokens."""

    def __init__(self, tokens: list[str]):
        clean = [("^" + (t.lower().strip(_marks) or t) + "$").encode("utf-8", "replace") for t in tokens]
        size = np.fromiter(map(len, clean), np.int64, len(clean))
        x = np.frombuffer(b"".join(clean) + b"$$$$", np.uint8).astype(np.uint64)
        ends = np.cumsum(size)
        starts = ends - size
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max(initial=1)), np.uint64(1099511628211)))
            local = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(starts, size)
            whole = np.add.reduceat(x[: len(local)] * power[local], starts) if len(clean) else np.zeros(0, np.uint64)
            self.words = ((whole * _mix) >> np.uint64(64 - 14)).astype(np.int64)
            tri = ((x[:-2] + x[1:-1] * np.uint64(257) + x[2:] * np.uint64(66049)) * _mix >> np.uint64(64 - 13)).astype(np.int64)

            def five(at: np.ndarray, salt: int) -> np.ndarray:
                h = np.full(len(at), np.uint64(salt))
                for k in range(5):
                    h = (h ^ x[np.minimum(at + k, ends - 1)]) * np.uint64(1099511628211)
                return (h * _mix >> np.uint64(64 - 13)).astype(np.int64)

            edge = np.stack([five(starts, 17), five(np.maximum(starts, ends - 5), 29)], 1).reshape(-1) if len(clean) else np.zeros(0, np.int64)
        self.counts = size  # size - 2 trigrams and two edges
        self.offsets = np.cumsum(self.counts) - self.counts
        self.flat = np.empty(int(self.counts.sum()), np.int64)
        place = np.arange(len(self.flat)) - np.repeat(self.offsets, self.counts)
        inner = place < np.repeat(size - 2, size)
        self.flat[inner] = tri[: len(local)][local < np.repeat(size - 2, size)]
        self.flat[~inner] = edge

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, piece ids and piece counts of some tokens."""
        n = self.counts[rows]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[rows], n)
        return self.words[rows], self.flat[at], n


def windows(n: int) -> range:
    """Starts of the windows of a text of n words."""
    return range(0, max(1, n - STRIDE), STRIDE) if n else range(0)


class ToxModel:
    """Embeddings of words and character pieces, both directions, attention and output weights."""

    def __init__(self, p: dict[str, np.ndarray], base: float = 0.0):
        self.p, self.base = p, base

    def inputs(self, words: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vector of each word."""
        if not len(words):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        c = np.add.reduceat(self.p["ec"].take(chars, axis=0), np.cumsum(counts) - counts, axis=0)
        return np.hstack([self.p["ew"][words], c / np.sqrt(counts)[:, None].astype(np.float32)])

    def gates(self, v: np.ndarray) -> list[np.ndarray]:
        """Gate inputs (words, H) of the forward, then the backward direction."""
        return [v @ self.p[w][:, k] + self.p[b][k] for w, b in (("wf", "bf"), ("wb", "bb")) for k in range(3)]

    def logits(self, tables: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logit of each window; flat: word rows of all texts one after the other."""
        out = np.empty(len(starts))
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), LANES):
            part = order[at: at + LANES]
            size = lengths[part]
            ids = flat[np.minimum(starts[part] + np.arange(size[0])[:, None], len(flat) - 1)]
            num, den = np.zeros((len(part), 2 * HIDDEN), np.float32), np.zeros((len(part), 1), np.float32)
            vf, vb = self.p["v"][:HIDDEN], self.p["v"][HIDDEN:]

            def visit(t: int, n: int, hf: np.ndarray, hb: np.ndarray, num=num, den=den) -> None:
                e = np.exp(np.clip(hf @ vf + hb @ vb, -30, 30))[:, None]
                num[:n, :HIDDEN] += e * hf
                num[:n, HIDDEN:] += e * hb
                den[:n] += e

            gru.run(ids, size, (tables[:3], self.p["uf"]), (tables[3:], self.p["ub"]), visit)
            out[part] = (num / den) @ self.p["w"] + self.p["b"][0]
        return out


class Scorer:
    """Scores texts with a bounded cache of word inputs."""

    def __init__(self, model: ToxModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.tables = [np.empty((0, HIDDEN), np.float32)] * 6

    def window_logits(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows, their text, their start word, and the word rows."""
        words = [(t or "").split() for t in texts]
        if len(self.row) > CACHE:
            self.clear()
        row, new = self.row, []
        for ws in words:
            for w in set(ws):
                if w not in row:
                    row[w] = len(row)
                    new.append(w)
        if new:
            x = Pieces(new)
            gates = self.model.gates(self.model.inputs(x.words, x.flat, x.counts))
            self.tables = [np.concatenate([a, b.astype(np.float32)]) for a, b in zip(self.tables, gates)]
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter(map(row.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes
        own = [np.array(windows(n)) for n in sizes]
        owner = np.repeat(np.arange(len(words)), [len(x) for x in own])
        local = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
        lengths = np.minimum(WINDOW, sizes[owner] - local) if len(owner) else np.zeros(0, np.int64)
        logits = self.model.logits(self.tables, flat, base[owner] + local, lengths) if len(owner) else np.zeros(0)
        return logits, owner, local, lengths

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Highest window probability of each text (no word: 0) and the first word of that window (-1)."""
        logits, owner, local, _ = self.window_logits(texts)
        best, at = np.full(len(texts), -np.inf), np.full(len(texts), -1)
        np.maximum.at(best, owner, logits)
        hit = np.flatnonzero(logits == best[owner]) if len(owner) else []
        at[owner[hit][::-1]] = local[hit][::-1]
        return 1 / (1 + np.exp(-np.clip(best - self.model.base, -50, 50))) * (at >= 0), at


def train(rows: list[tuple[int, str]], seed: int = 5) -> ToxModel:
    """Fit on (label, text) rows. The label is the text's; in each round the window of a positive text that scores
    highest stands for it, first chosen by the log-odds of its rarest-in-negatives word, then by the network. Negative
    texts give a random window and their highest. The order of ``rows`` does not matter. Without both classes: score 0."""
    rows = sorted(rows)
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"ew": rng.standard_normal((WORD_IDS, WORD_DIM)) * 0.02, "ec": rng.standard_normal((CHAR_IDS, CHAR_DIM)) * 0.1, "wf": rng.standard_normal((d, 3, h)) / np.sqrt(d) * 2,
         "wb": rng.standard_normal((d, 3, h)) / np.sqrt(d) * 2, "bf": np.zeros((3, h)), "bb": np.zeros((3, h)), "v": rng.standard_normal(2 * h) * 0.5, "w": rng.standard_normal(2 * h) * 0.5, "b": np.array([-1.0])}
    p = {k: x.astype(np.float32) for k, x in p.items()} | {"uf": gru.init(rng, h), "ub": gru.init(rng, h)}
    model = ToxModel(p)
    y = np.array([label for label, _ in rows])
    texts = [t.split() for _, t in rows]
    if len(set(y.tolist())) < 2:
        p["w"][:], p["b"][:] = 0, 30.0 if len(y) and y[0] else -30.0
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    pieces = Pieces(list(vocabulary))
    lists = [np.array([vocabulary[w] for w in ws], np.int64) for ws in texts]
    # first choice of windows: log-odds of words and character pieces over the texts that hold them
    seen = np.zeros((2, WORD_IDS + CHAR_IDS))
    for label, ws in zip(y, lists):
        own, chars, _ = pieces.take(np.unique(ws))
        seen[label, np.unique(np.concatenate([own, WORD_IDS + chars]))] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    odds = np.where(seen.sum(0) >= 3, odds, 0)
    per_word = np.maximum(odds[pieces.words], np.maximum.reduceat(odds[WORD_IDS + pieces.flat], pieces.offsets)) if len(vocabulary) else odds[:0]
    value = [per_word[ws] for ws in lists]

    def best_by_odds(i: int) -> int:
        return max(windows(len(value[i])), key=lambda s: sum(sorted(value[i][s: s + WINDOW])[-3:]), default=0)

    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pos, neg = (np.array([i for i in x if texts[i]], int) for x in (pos, neg))
    if not len(pos) or not len(neg):
        p["w"][:], p["b"][:] = 0, -30.0
        return model
    chosen = {i: best_by_odds(i) for i in pos}
    hard = {i: best_by_odds(i) for i in neg}
    adam = gru.Adam(p, 0.01)
    for rnd in range(ROUNDS):
        if rnd:
            scorer = Scorer(model)
            for part in np.array_split(np.concatenate([pos, neg]), max(1, len(rows) // 200)):
                at = scorer.scores([" ".join(texts[i]) for i in part])[1]
                for i, s in zip(part, at):
                    (chosen if y[i] else hard)[i] = int(s)
        for _ in range(STEPS):
            up, down = rng.choice(pos, 48), rng.choice(neg, 80)
            wins = [(i, chosen[i]) for i in up]
            for i in down:
                w = windows(len(texts[i]))
                wins.append((i, hard[i] if rng.random() < 0.5 else w[int(rng.integers(len(w)))]))
            size = [min(WINDOW, len(lists[i]) - s) for i, s in wins]
            ids, mask = np.zeros((max(size), len(wins)), np.int64), np.zeros((max(size), len(wins), 1), np.float32)
            for j, (i, s) in enumerate(wins):
                own = lists[i][s: s + size[j]]
                ids[: size[j], j] = own[int(rng.integers(len(own)))] if y[i] == 0 and rng.random() < REPEATED else own
                mask[: size[j], j] = 1
            rows_, ids = np.unique(ids, return_inverse=True)
            adam.step(gradients(model, *pieces.take(rows_), ids, mask, np.array([y[i] for i, _ in wins], np.float32)), 1.0 if rnd < ROUNDS - 2 else 0.3)
    return model


def gradients(model: ToxModel, words: np.ndarray, chars: np.ndarray, counts: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross-entropy of the windows ``ids`` (T, B)."""
    p, h = model.p, HIDDEN
    v = model.inputs(words, chars, counts).astype(np.float32)
    f, b = (np.stack(x, 1) for x in (model.gates(v)[:3], model.gates(v)[3:]))
    hf, tf = gru.forward(f[ids], mask, p["uf"])
    hb, tb = gru.forward(b[ids[::-1]], mask[::-1], p["ub"])
    both = np.concatenate([hf, hb[::-1]], 2)
    e = np.exp(np.clip(both @ p["v"], -30, 30)) * mask[..., 0]
    a = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, both)
    z = pooled @ p["w"] + p["b"][0]
    dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
    d_pooled = dz[:, None] * p["w"]
    da = np.einsum("tbh,bh->tb", both, d_pooled)
    de = a * (da - (a * da).sum(0))
    d_both = a[..., None] * d_pooled + de[..., None] * p["v"]
    da_f, duf = gru.backward(d_both[..., :h], mask, p["uf"], tf)
    da_b, dub = gru.backward(np.ascontiguousarray(d_both[::-1, :, h:]), mask[::-1], p["ub"], tb)
    gf, gb = np.zeros_like(f), np.zeros_like(b)
    np.add.at(gf, ids, da_f)
    np.add.at(gb, ids[::-1], da_b)
    dv = np.einsum("nkh,dkh->nd", gf, p["wf"]) + np.einsum("nkh,dkh->nd", gb, p["wb"])
    g = {"wf": np.einsum("nd,nkh->dkh", v, gf), "wb": np.einsum("nd,nkh->dkh", v, gb), "bf": gf.sum(0), "bb": gb.sum(0), "uf": duf, "ub": dub,
         "v": np.einsum("tb,tbh->h", de, both), "w": dz @ pooled, "b": np.array([dz.sum()]), "ew": 1e-5 * p["ew"], "ec": 1e-5 * p["ec"]}
    np.add.at(g["ew"], words, dv[:, :WORD_DIM])
    np.add.at(g["ec"], chars, np.repeat(dv[:, WORD_DIM:] / np.sqrt(counts)[:, None], counts, axis=0))
    return g


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, str]]:
    """The bounded training sample: at most per_class texts of each label, first by hash, of at most MAX_CHARS characters
    (longer texts are left out of training, never cut; all are scored). The sample's ids are drawn first, from ids and
    hashes alone; then the texts of these ids are fetched, so no other text moves."""
    light = docs.filter(F.length("text").between(1, MAX_CHARS)).select("doc_id", F.xxhash64("text").alias("o"))
    light = labelled(light, labels, "toxic").filter("y IN (0.0, 1.0)")
    ids = [(r["doc_id"], int(r["y"])) for r in sample_per_class(light, "y", F.struct("o", "doc_id"), per_class).select("doc_id", "y").collect()]
    if not ids:
        return []
    drawn = docs.sparkSession.createDataFrame(sorted(set(ids)), "i long, y int")
    got = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("i")).filter(F.length("text").between(1, MAX_CHARS))
    return [(r["y"], r["text"]) for r in got.select("y", "text").collect()]


def score_text(df: DataFrame, model: ToxModel, text: str = "text", into: str = "score", at: str = "window_start") -> DataFrame:
    """``df`` with a score (0 to 1, the highest over all windows of the whole text) and the first word of that window.
    Null texts and texts without a word: 0 and -1. Equal texts get equal results."""
    def make():
        scorer = Scorer(model)

        def f(texts: list) -> dict:
            s, where = scorer.scores(texts)
            return {into: s, at: where}
        return f

    return with_text_column(df, text, make, f"{into} double, {at} long")


def predict_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, window_start. Held out (crc32 of the id modulo 3 is 1)
    or without an id: never learned from."""
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = train(training_rows(docs.filter(~held), labels))
    out = score_text(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "window_start")
