"""GIF media columns: lossless storage of byte payloads as animated 8-bit frames, and a full decoder.

The decoder reads LZW code streams, applies global and local palettes, disposal and transparency rules and interlacing,
and gives the composed canvas of every frame with its delay.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_column

#: Pixels per row of a stored frame, rows per frame and delay of a frame in hundredths of a second.
WIDTH, HEIGHT, DELAY = 64, 256, 4
#: Colour-histogram columns: bins over the red, green and blue axis.
HIST = 16

_grey = bytes(v for g in range(256) for v in (g, g, g))


def lzw_encode(pixels: bytes, min_bits: int = 8) -> bytes:
    """GIF code stream: clear code first, codes grow from min_bits + 1 to 12 bits, a clear code when the table is full."""
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    codes, marks = [clear], [0]  # marks: where each table starts
    emit = codes.append
    if pixels:
        table: dict[int, int] = {}
        get, nxt = table.get, stop + 1
        prefix = pixels[0]
        for b in memoryview(pixels)[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
            else:
                emit(prefix)
                prefix = b
                if nxt < 4096:
                    table[key] = nxt
                    nxt += 1
                else:
                    marks.append(len(codes))
                    emit(clear)
                    table.clear()
                    nxt = stop + 1
        emit(prefix)
    emit(stop)
    codes_a = np.array(codes, np.int64)
    marks_a = np.array(marks)
    # after k codes behind a clear code the table holds stop + k entries; the code that follows is as wide as they need
    since = np.arange(len(codes)) - np.repeat(marks_a, np.diff(np.append(marks_a, len(codes))))
    known = stop + since - 1  # highest entry when the code is written (first code after the clear code adds none)
    width = np.maximum(min_bits + 1, np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1)
    width = np.minimum(width, 12)
    width[marks_a[1:]] = 12  # a clear code comes at full width
    width[0] = min_bits + 1
    return _pack(codes_a, width)


def _pack(codes: np.ndarray, width: np.ndarray) -> bytes:
    at = np.cumsum(width) - width
    bits = np.zeros(int(at[-1] + width[-1]) + 16, np.uint8)
    for k in range(12):
        on = width > k
        bits[at[on] + k] = (codes[on] >> k) & 1
    return np.packbits(bits[: int(at[-1] + width[-1])], bitorder="little").tobytes()


def lzw_decode(data: bytes, min_bits: int, limit: int) -> bytes:
    """Pixels of a code stream, at most ``limit``. Codes may come before the first clear code, tables may stay full,
    streams may end without a stop code. Raises ValueError on a code that no table holds."""
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    room = 4096 - clear - 2
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    # width of the k-th code behind a clear code: one entry is added from the second code on, until the table is full
    known = np.minimum(clear + 2 + np.maximum(np.arange(room + 2) - 1, 0), 4095)
    schedule = np.maximum(min_bits + 1, np.floor(np.log2(known)).astype(np.int64) + 1)
    offsets = np.concatenate([[0], np.cumsum(schedule)])
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    end, at, out, emitted = 8 * len(data), 0, [], 0
    emit, full, table, known_now, previous = out.append, False, base.copy(), clear + 2, b""
    while at < end and emitted < limit:
        if full:  # a table that stays full: codes of 12 bits
            pos = at + 12 * np.arange(min(room, (end - at) // 12) + 1)
            width = np.full(len(pos) - 1, 12)
        else:
            pos = at + offsets[: int(np.searchsorted(offsets, end - at, side="right"))]
            width = schedule[: len(pos) - 1]
        start = pos[:-1]
        i = start >> 3
        codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (start & 7) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else len(codes)
        run = codes[:n].tolist()
        if run and not previous:
            if run[0] >= clear:
                raise ValueError(f"code {run[0]} is not in the table")
            previous = table[run.pop(0)]
            emit(previous)
            emitted += len(previous)
        grow = run[: 4096 - known_now]
        push = table.append
        for code in grow:
            if code < known_now:
                entry = table[code]
            elif code == known_now:
                entry = previous + previous[:1]
            else:
                raise ValueError(f"code {code} is not in the table")
            push(previous + entry[:1])
            known_now += 1
            emit(entry)
            emitted += len(entry)
            previous = entry
            if emitted >= limit:
                break
        else:
            for code in run[len(grow):]:
                previous = table[code]
                emit(previous)
                emitted += len(previous)
                if emitted >= limit:
                    break
        if len(marks):
            if codes[n] == stop:
                break
            at = int(pos[n + 1])
            full, table, known_now, previous = False, base.copy(), clear + 2, b""
        elif n == 0:
            break
        else:
            at, full = int(pos[-1]), True
    return b"".join(out)[:limit]


def blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, with the closing empty one."""
    return b"".join(bytes([len(data[i: i + 255])]) + data[i: i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold ``payload`` (a positive multiple of ``width`` bytes) as grey values, row by row; the last
    frame covers as many rows as are left."""
    if not payload or len(payload) % width:
        raise ValueError(f"payload must be a positive multiple of {width} bytes")
    rows = len(payload) // width
    parts = [b"GIF89a", width.to_bytes(2, "little"), min(rows, height).to_bytes(2, "little"), b"\xf7\0\0", _grey,
             b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for top in range(0, rows, height):
        pixels = payload[top * width: (top + height) * width]
        parts += [b"\x21\xf9\x04\x04", delay.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(pixels) // width).to_bytes(2, "little"), b"\0\x08", blocks(lzw_encode(pixels))]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """One composed frame: canvas (height, width, 3), alpha (height, width), the image's own rectangle and its delay."""
    canvas: np.ndarray
    alpha: np.ndarray
    rect: tuple[int, int, int, int]
    delay: int


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)


def decode(data: bytes, keep: bool = True, visit=None) -> Gif:
    """All frames of a GIF. ``visit(frame)`` is called for each; with keep=False frames are not held. ValueError if the
    data is no GIF or breaks off inside a frame; trailing bytes after the trailer are ignored."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    u16 = lambda i: data[i] | data[i + 1] << 8
    gif = Gif(u16(6), u16(8))
    flags, pos = data[10], 13
    palette = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, pos = np.frombuffer(data[pos: pos + 3 * n], np.uint8).reshape(-1, 3), pos + 3 * n
    canvas, alpha = np.zeros((gif.height, gif.width, 3), np.uint8), np.zeros((gif.height, gif.width), bool)
    control = (0, 0, None)  # disposal, delay, transparent index

    def sub_blocks(at: int) -> tuple[bytes, int]:
        got = []
        while True:
            if at >= len(data):
                raise ValueError("the data breaks off")
            n = data[at]
            if not n:
                return b"".join(got), at + 1
            got.append(data[at + 1: at + 1 + n])
            at += n + 1

    while pos < len(data):
        kind = data[pos]
        if kind == 0x3B:
            return gif
        if kind == 0x21:
            label = data[pos + 1]
            body, pos = sub_blocks(pos + 2)
            if label == 0xF9:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = body[12] | body[13] << 8
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        x, y, w, h, flags = u16(pos + 1), u16(pos + 3), u16(pos + 5), u16(pos + 7), data[pos + 9]
        pos += 10
        colours = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours, pos = np.frombuffer(data[pos: pos + 3 * n], np.uint8).reshape(-1, 3), pos + 3 * n
        if colours is None:
            raise ValueError("no palette")
        body, end = sub_blocks(pos + 1)
        pixels = lzw_decode(body, data[pos], w * h)
        pos = end
        if len(pixels) < w * h:
            raise ValueError("the code stream breaks off")
        image = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            whole = np.empty_like(image)
            whole[order] = image
            image = whole
        disposal, delay, clear = control
        control = (0, 0, None)
        before = (canvas.copy(), alpha.copy()) if disposal == 3 else None
        shown = image[: max(0, gif.height - y), : max(0, gif.width - x)]
        area = canvas[y: y + shown.shape[0], x: x + shown.shape[1]], alpha[y: y + shown.shape[0], x: x + shown.shape[1]]
        if clear is None:
            area[0][:], area[1][:] = colours[np.minimum(shown, len(colours) - 1)], True
        else:
            on = shown != clear
            area[0][on], area[1][on] = colours[np.minimum(shown[on], len(colours) - 1)], True
        frame = Frame(canvas.copy() if keep else canvas, alpha.copy() if keep else alpha, (x, y, w, h), delay)
        if visit:
            visit(frame)
        if keep:
            gif.frames.append(frame)
        if disposal == 2:
            area[0][:], area[1][:] = 0, False
        elif disposal == 3:
            canvas, alpha = before
    raise ValueError("the data breaks off")


def histogram(canvas: np.ndarray, bins: int = HIST) -> np.ndarray:
    """Counts of the red, green and blue values in equal bins: (3, bins)."""
    return np.stack([np.bincount(canvas[..., c].ravel() // (256 // bins), minlength=bins) for c in range(3)])


def store(text: str | None) -> tuple[bytes, int]:
    """The stored form of a text (null: empty) and its length in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return encode(raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))), len(raw)


def read_back(media: bytes) -> tuple[bytes, np.ndarray, list[int]]:
    """The payload of a stored form, the summed colour histogram of its frames and their delays."""
    got, total, delays = [], np.zeros((3, HIST), np.int64), []

    def visit(frame: Frame) -> None:
        x, y, w, h = frame.rect
        part = np.ascontiguousarray(frame.canvas[y: y + h, x: x + w])
        got.append(np.ascontiguousarray(part[..., 0]).tobytes())
        total[:] += histogram(part)
        delays.append(frame.delay)

    decode(media, keep=False, visit=visit)
    return b"".join(got), total, delays


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``media`` (binary GIF of the text) and what is read back from it: n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, duration_cs, hist (48 counts: red, green and blue in
    16 bins each), feature. Null and empty texts give one frame of 64 zero bytes; equal texts give equal values; the
    working memory is that of one text."""
    def make():
        def f(texts: list) -> dict:
            out = {k: [] for k in ("media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_cs", "hist", "feature")}
            for t in texts:
                media, n = store(t)
                payload, hist, delays = read_back(media)
                values = (media, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(delays), sum(delays), hist.ravel().tolist(),
                          f"{len(delays)} frames, grey16=" + ",".join(map(str, hist[0].tolist())))
                for k, v in zip(out, values):
                    out[k].append(v)
            return out
        return f

    return with_text_column(df, text, make, "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
                                            "n_frames long, duration_cs long, hist array<long>, feature string")


def digest_documents(docs: DataFrame) -> DataFrame:
    """One row per document with the figures of its stored form, without the media itself."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_cs"]
    return with_media(docs.select(F.col("doc_id"), F.col("text"))).select("doc_id", *names)
