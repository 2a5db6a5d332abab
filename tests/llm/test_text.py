"""Media, HTML and token operators against plain versions and exact round trips."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import gif, htmlmain, tokencount, tokens

TEXTS = [None, "", "abc", "a" * 5000, "line one\nline two é ñ\n\n end", "x" * 64, "\U0001f600 ok", "abc", "word " * 20_000]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8))
def test_lzw_round_trip(data, bits):
    data = bytes(b & ((1 << bits) - 1) for b in data)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data) + 5) == data


def plain_decode(data, min_bits):
    """Textbook decoder, a bit at a time."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, stop, width, pos, table, old, out = 1 << min_bits, (1 << min_bits) + 1, min_bits + 1, 0, None, None, b""
    while pos + width <= len(bits):
        code = int(bits[pos: pos + width][::-1], 2)
        pos += width
        if code == clear:
            table, width, old = [bytes([i]) for i in range(clear)] + [None, None], min_bits + 1, None
        elif code == stop:
            break
        else:
            entry = table[code] if code < len(table) else old + old[:1]
            out += entry
            if old is not None and len(table) < 4096:
                table.append(old + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            old = entry
    return out


def test_lzw_streams_agree_with_plain_decoder():
    r = random.Random(3)
    for n in (0, 1, 700, 30_000):
        data = bytes(r.choice(b"abcdefgh") if r.random() < 0.9 else r.randrange(256) for _ in range(n))
        assert plain_decode(gif.lzw_encode(data), 8) == data


def test_lzw_without_clear_codes_and_broken_streams():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(12_000))  # the table fills and stays full
    table, codes, prefix = {bytes([i]): i for i in range(256)}, [256], b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
        else:
            codes.append(table[prefix])
            if len(table) + 2 < 4096:
                table[prefix + bytes([b])] = len(table) + 2
            prefix = bytes([b])
    codes += [table[prefix], 257]
    known, bits = 258, ""
    for k, code in enumerate(codes):
        width = 9 if k < 2 else min(12, max(9, min(4095, 258 + k - 2).bit_length()))
        bits += f"{code:0{width}b}"[::-1]
    raw = bytes(int(bits[i: i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert known and gif.lzw_decode(raw, 8, len(data)) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([255] * 20), 8, 100)


def build(width, height, frames, palette):
    out = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\xf1\0\0" + palette
    for x, y, w, h, px, disposal, clear, flags, local in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + local + b"\x02" + gif.blocks(gif.lzw_encode(bytes(px), 2))
    return out + b"\x3b"


def test_disposal_transparency_interlace_and_palettes():
    pal = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = build(2, 2, [(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 0, b""), (0, 0, 1, 1, [2], 3, None, 0, b""), (1, 0, 1, 2, [0, 3], 2, 0, 0, b""), (0, 0, 2, 2, [1, 0, 0, 1], 0, 0, 0x81, local)], pal)
    g = gif.decode(data)
    px = [f.canvas.reshape(-1, 3).tolist() for f in g.frames]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert px[0] == [red] * 4 and px[1] == [green, red, red, red]
    assert px[2] == [red, red, red, blue]  # the second frame was undone, index 0 is clear
    assert px[3] == [[8, 8, 8], [0, 0, 0], red, [8, 8, 8]] and not g.frames[3].alpha[0, 1]
    assert [f.delay for f in g.frames] == [7] * 4
    inter = build(1, 9, [(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], 0, None, 0x40, b"")], pal)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    rows = gif.decode(inter).frames[0].canvas[:, 0].tolist()
    assert [rows[r] for r in order] == [list(pal[3 * i: 3 * i + 3]) for i in [0, 1, 2, 3, 0, 1, 2, 3, 0]]
    for cut in (3, 20, len(data) - 8):
        with pytest.raises(ValueError):
            gif.decode(data[:cut])


def test_media_columns(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, feature string")
    out = {r["doc_id"]: r for r in gif.with_media(df).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and gif.read_back(bytes(r["media"]))[0] == payload
        assert sum(r["hist"]) == 3 * len(payload) and r["duration_cs"] == 4 * r["n_frames"]
    assert out[2]["media_sha256"] == out[7]["media_sha256"] and out[0]["payload_sha256"] == out[1]["payload_sha256"]
    assert gif.digest_documents(df.filter("false")).count() == 0


# ---------------------------------------------------------------- pages
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        s = htmlmain.shared_lines(a, b)
        rest = iter(b)
        assert len(s) == length(a, b) and all(any(x == y for y in rest) for x in [a[i] for i in s])
    a, b = ([r.randint(0, 30) for _ in range(3000)] for _ in range(2))
    whole = len(htmlmain._lcs(a, b))
    lcs = htmlmain._lcs
    monkeypatch.setattr(htmlmain, "_lcs", lambda x, y: lcs(x, y))
    half = len(a) // 2
    assert whole >= len(lcs(a[:half], b))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad-box">Buy</div><div id='cookie-notice'>We use<div>cookies</div></div><main><article><header><h1>A &amp; B &lt;i&gt;</h1></header><p><b>One
 two<br>three</p><p title="a > b">Four &eacute;&nbsp;x<script>1<2</script><form><input>F</form><section class="comments"><p>nice</p></section></article></main>
<aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_blocks():
    assert [t for t, z in htmlmain.blocks(PAGE) if z == htmlmain.MAIN] == ["A & B <i>", "One two three", "Four é x"]
    assert htmlmain.blocks(None) == [] and htmlmain.blocks("") == [] and htmlmain.blocks("plain  text") == [("plain text", htmlmain.PLAIN)]
    assert htmlmain.blocks("<div class=ad>x<article><p>y") == [("x", 2), ("y", 0)]
    assert [t for t, z in htmlmain.blocks("<p>a<p>b &am <p>c &#65;<") if z == htmlmain.PLAIN] == ["a", "b &am", "c A<"]


def test_extract(spark):
    menu, foot = "<p>menu line</p><p>second menu</p>", "<p>foot line</p>"
    body = lambda i: "<body>" + menu + f"<p>text {i} only here</p><p>more {i}</p>" + foot
    rows = [(1, "http://h.org/en/1?x=1", body(1)), (2, "http://h.org/en/2#top", body(2)), (3, "http://h.org/en/2", body(2)), (4, None, body(4)), (5, "http://h.org/en/9", None), (None, "http://lone.org/", PAGE),
            (7, "http://lone2.org/a", body(7)), (7, "http://lone2.org/a", body(7)), (8, "not a url", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = htmlmain.extract(df).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert by[1] == "text 1 only here\n\nmore 1" and by[2] == by[3] == "text 2 only here\n\nmore 2"
    assert by[4].startswith("menu line") and by[7].startswith("menu line") and by[5] == by[8] == "" and by[None].startswith("A & B")
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert htmlmain.extract_pages(df.filter("false")).count() == 0


def test_copies_do_not_delete_each_other(spark):
    p = "<body><p>one</p><p>two</p><p>three</p>"
    df = spark.createDataFrame([(1, "http://h/a/1", p), (2, "http://h/a/2", p)], "page_id long, url string, html string")
    assert {r["text"] for r in htmlmain.extract(df).collect()} == {"one\n\ntwo\n\nthree"}


def test_differencing_decides_the_lines_beside_an_article(spark):
    page = lambda i: f"<nav>menu</nav><p>unmarked menu</p><p>own {i}</p><article><p>text {i}</p><p>both say this</p></article><p>unmarked foot</p>"
    df = spark.createDataFrame([(i, f"http://h/a/{i}", page(i)) for i in range(3)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmlmain.extract(df).collect()} == {i: f"own {i}\n\ntext {i}\n\nboth say this" for i in range(3)}


# ---------------------------------------------------------------- tokens
@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet=" \n\t'asdl<|endoftext|>0é", max_size=80))
def test_encoder_equals_tokenizers(text):
    enc = tokens.encoder(tokens.default_path())
    want = enc.exact.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
    assert enc.encode(text).tolist() == want


def test_encoder_special_and_long_runs():
    enc = tokens.encoder(tokens.default_path())
    for t in ("a<|endoftext|>b", "x" * 5000, " " * 6000 + "y", "it's  we'll\n\n\n no"):
        assert enc.encode(t).tolist() == enc.exact.encode(t, add_special_tokens=False).ids
        assert enc.bytes_of[enc.encode(t)].sum() == len(t.encode())


def test_attribution_against_offsets():
    enc = tokens.encoder(tokens.default_path())
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(["the ", "énorme ", "\n", "\n\n", "zz", "\U0001f600", " x"]) for _ in range(r.randint(0, 40)))
        cuts = sorted({0, len(text), *(r.randint(0, len(text)) for _ in range(4))})
        spans = list(zip(cuts, cuts[1:])) or [(0, 0)]
        got = tokencount.count_text(text, spans, enc)
        raw = text.encode()
        ends = np.cumsum(enc.bytes_of[enc.encode(text)]).tolist()
        toks = list(zip([0, *ends[:-1]], ends))
        for k, (a, b) in enumerate(spans):
            lo, hi = len(text[:a].encode()), len(text[:b].encode())
            assert got["by_start"][k] == sum(lo <= s < hi for s, _ in toks)
            assert got["by_end"][k] == sum(lo < e <= hi for _, e in toks)
            share = [max(0, min(e, hi) - max(s, lo)) / (e - s) for s, e in toks]
            assert got["share"][k] == pytest.approx(sum(share))
            assert got["crossing"][k] == sum(0 < x < 1 for x in share)
        assert len(raw) == (ends[-1] if ends else 0) and sum(got["by_start"]) == len(toks)


def test_overlapping_and_gapped_sections():
    got = tokencount.attribute(np.array([3, 6, 9]), np.array([0, 2, 7]), np.array([4, 8, 7]))
    assert got["by_start"].tolist() == [2, 2, 0] and got["by_end"].tolist() == [1, 2, 0]
    assert got["share"].tolist() == pytest.approx([4 / 3, 2.0, 0]) and got["crossing"].tolist() == [1, 2, 0]


def test_section_rows(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    out = tokencount.with_section_counts(df).collect()
    enc = tokens.encoder(tokens.default_path())
    for r in out:
        t = r["text"] or ""
        assert r["n_tokens"] == len(enc.encode(t)) == sum(s["n_tokens"] for s in r["sections"]) and len(r["sections"]) == max(1, t.count("\n") + (not t.endswith("\n")))
    assert tokencount.count_documents(df.filter("false")).count() == 0
    assert tokencount.count_documents(df).filter(F.col("doc_id") == 1).count() == 1
