"""Sentence pieces, spelling variants and the conversation trie against the library and brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marketlens.llm import pieces, spelling, trie

ODD = ["", None, " ", "  a  b  ", "x▁y ▁ z", "  a  b  ", "é\U0001F600　q\x00r\n\tz" + "a" * 5000, "the the the\n\nthe", "\n", "<s> </s> <0x0A>"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.mark.parametrize("block,share", [(pieces.BLOCK, pieces.SHARE), (200, 100), (1, 1)])
def test_pieces_equal_the_library(spark, library, block, share):
    rows = [(None if i == 4 else i % 7, t, i) for i, t in enumerate(ODD + [f"word{i}  lo rem " * 40 for i in range(30)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    got = pieces.encode(df, block=block, share=share).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((d or -1, t or "") for d, t, _ in rows)
    assert all(r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True) for r in got)
    assert pieces.encode(df.filter("false"), block=block, share=share).count() == 0
    back = pieces.encode(df, keep=["text"], block=block, share=share).select("text", pieces.decode("ids")["text"].alias("d")).collect()
    assert all(r["d"] == library.decode(library.encode(r["text"] or "")) for r in back)


def test_each_word_is_segmented_once(spark, monkeypatch):
    seen = []

    class Counting:
        def __init__(self, sp):
            self.sp = sp

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def encode(self, words):
            seen.extend(words)
            return self.sp.encode(words)

    sp = Counting(pieces.processor(pieces.default_model()))
    monkeypatch.setattr(pieces, "processor", lambda model: sp)
    import pyarrow as pa

    def sent(block, words):
        return next(pieces._wire([3], pieces.WORDS, block, [3], [len(words)], [zstandard.compress(pieces.STOP.join(words))], None, pa.int32()))

    list(pieces._segment(iter([sent(0, [b"one", b"two", b""]), sent(1, [b"two", b"six"])]), "m"))
    assert sorted(seen) == ["one", "six", "two"]


def test_pieces_query_digests(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.digest_documents(df).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_model_whose_pieces_cross_markers_is_refused(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.pieces[400].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.processor(str(tmp_path / "m.model"))


# ---------------------------------------------------------------- conversation trie
CONV = "conv_id long, turn long, role string, text string, words long, node long"


def plain_trie(rows):
    """Nodes by sequence, with sums over subtrees by definition; ties in turn must be equal rows."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
        w = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * w + sum(saved[x] for x in kids.get(k, []))
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        for t in range(r.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c * r.choice([1, 1, 3]) if c else 0, t, r.choice(["user", None, ""]), r.choice(["a b", "a", None, "", "c  d\te"])))
    rows = [x for i, x in enumerate(rows) if not any(x[:2] == y[:2] for y in rows[:i])]
    rows += [(2000, t, "u", "same words here") for t in range(90)] + [(2001, t, "u", "same words here") for t in range(70)]
    rows += [(c, t, "u", "common") for c in range(3000, 3100) for t in range(2)]
    rows += [(7, None, "u", "first"), (None, 1, "u", "nobody's"), (9, 50, "u", "twice"), (9, 50, "u", "twice")]
    return rows


@pytest.mark.parametrize("small", [30, trie.SMALL])
def test_trie_equals_plain(spark, small, monkeypatch):
    rows = conversations(small)
    if small == 30:
        monkeypatch.setattr(trie, "HOT", 10)  # frequent keys go by broadcast
    df = spark.createDataFrame([(*x, 5, 6) for x in rows], CONV)
    got = sorted((tuple(r) for r in trie.trie(df, small=small).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([(None, 1, "u", "x", 1, 1)], CONV)).count() == 0


def test_cuts_halve_the_load(spark, monkeypatch):
    """A path of 60 turns is cut in about as many rounds as its length has binary digits."""
    rounds = []
    small = trie._small
    monkeypatch.setattr(trie, "_small", lambda *a: rounds.append(1) or small(*a))
    df = spark.createDataFrame([(40, t, "u", "w", 1, 1) for t in range(60)], CONV)
    assert trie.trie(df, small=1).count() == 61
    assert len(rounds) <= 8


# ---------------------------------------------------------------- spelling variants
def one_change(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    n = {}
    for i, t in docs:
        for run in re.findall("[a-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")):
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if v != w and one_change(w, v)] for w in n}
    form = {w: next((v for v in sorted(vs, key=lambda v: (-n[v], v)) if n[v] >= 2 * n[w]), None) if vs and max(n[v] for v in vs) >= 2 * n[w] else None for w, vs in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_equal_plain(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdeéÿ×") for _ in range(r.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ababab", "bababa", "abababa"]
    words = []
    for w in base:
        for _ in range(3):
            i, v = r.randrange(len(w)), w
            v = r.choice([v[:i] + v[i + 1:], v[:i] + r.choice("abé") + v[i:], v[:i] + r.choice("abcÿ") + v[i + 1:]])
            words += [v] * r.choice([1, 3, 4, 9])
        words += [w] * r.choice([3, 8, 20, 60])
    r.shuffle(words)
    docs = [(i % 300 or None, r.choice([" ", "-", "1", "\n"]).join(w.upper() if w.isascii() and r.random() < 0.2 else w for w in words[i: i + 9])) for i in range(0, len(words), 9)]
    docs += [(1, None), (2, ""), (3, "ab " * 2000), (3, "ab " * 2000), (4, "x" * 3000)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n long, word string").repartition(4)
    got = sorted((tuple(x) for x in spelling.group_documents(df).collect()), key=str)
    assert got == plain_variants(docs) and any(x[1] and x[1] != x[2] for x in got)
    assert spelling.group_documents(df.filter("false")).count() == 0


def test_pivots_are_the_rarest_two_that_do_not_overlap(spark):
    r = random.Random(2)
    cases = []
    for _ in range(200):
        at = sorted(r.sample(range(9), r.randrange(3, 7)))
        cases.append([(a, "g%d" % a, r.randrange(1, 6)) for a in at])
    df = spark.createDataFrame([(c,) for c in cases], "p array<struct<at:int,gram:string,uses:bigint>>")
    uses = [dict((a, u) for a, _, u in c) for c in cases]
    for (p,), u, c in zip(df.select(F.transform(spelling.pivots(F.col("p")), lambda x: x["at"])).collect(), uses, cases):
        best = min(u[a] + u[b] for a in u for b in u if b >= a + 2)
        assert p[1] >= p[0] + 2 and u[p[0]] + u[p[1]] == best
