"""Token counts of the sections of documents: whole texts are encoded once, tokens are joined to sections by their spans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_column
from .tokens import default_path, encoder


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of a text; a line break belongs to the line it ends. Empty text: one empty span."""
    spans, at = [], 0
    while True:
        cut = text.find("\n", at)
        if cut < 0:
            break
        spans.append((at, cut + 1))
        at = cut + 1
    if at < len(text) or not spans:
        spans.append((at, len(text)))
    return spans


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Joins tokens (byte ends, gapless from 0) to byte spans, which may touch, overlap or leave gaps.

    Per span: ``by_start`` tokens whose first byte lies in it, ``by_end`` tokens whose last byte does, ``share`` the sum
    of each token's share of bytes inside it, ``crossing`` tokens partly inside. Over spans that cover a text without
    overlap each of the first three sums to the number of tokens.
    """
    token_starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(token_ends, starts, side="right")  # first token that ends behind the span's start
    last = np.searchsorted(token_starts, ends, side="left")  # first token that starts at or behind its end
    by_start = np.searchsorted(token_starts, ends, side="left") - np.searchsorted(token_starts, starts, side="left")
    by_end = np.searchsorted(token_ends, ends, side="right") - np.searchsorted(token_ends, starts, side="right")
    empty = ends <= starts
    touched = np.where(empty, 0, last - first)
    if not len(token_ends):
        zero = np.zeros(len(starts), np.int64)
        return {"by_start": zero, "by_end": zero, "share": zero.astype(float), "crossing": zero}
    a, b = np.minimum(first, len(token_ends) - 1), np.minimum(np.maximum(last - 1, 0), len(token_ends) - 1)
    cut_a = np.where(touched > 0, np.maximum(0, starts - token_starts[a]) / (token_ends[a] - token_starts[a]), 0)
    cut_b = np.where(touched > 0, np.maximum(0, token_ends[b] - ends) / (token_ends[b] - token_starts[b]), 0)
    crossing = np.where((touched > 0) & (a == b), (cut_a > 0) | (cut_b > 0), (cut_a > 0).astype(int) + (cut_b > 0))
    return {"by_start": np.where(empty, 0, by_start), "by_end": np.where(empty, 0, by_end), "share": np.where(empty, 0, touched - cut_a - cut_b), "crossing": np.where(empty, 0, crossing)}


def count_text(text: str, sections: list[tuple[int, int]], enc) -> dict[str, np.ndarray]:
    """``attribute`` for character spans of one text."""
    raw = text.encode("utf-8", "replace")
    token_ends = np.cumsum(enc.bytes_of[enc.encode(text)])
    spans = np.array(sections, np.int64).reshape(-1, 2)
    if len(raw) != len(text):
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        spans = np.append(lead, len(raw))[spans]
    return attribute(token_ends, spans[:, 0], spans[:, 1])


def with_section_counts(df: DataFrame, text: str = "text", sections: Callable[[str], list[tuple[int, int]]] = line_sections, path: str | None = None) -> DataFrame:
    """``df`` with n_tokens (of the whole text) and ``sections``: array of (section, start_char, end_char, n_tokens,
    n_by_end, token_share, n_crossing). n_tokens of a section counts the tokens that start in it: the rule for tokens that
    cross a boundary; n_by_end and token_share follow the other two rules. Null and empty texts: no token."""
    path = path or default_path()

    def make():
        enc = encoder(path)

        def f(texts: list) -> dict:
            out: dict[str, list] = {"n_tokens": [], "sections": []}
            for t in texts:
                t = t or ""
                spans = sections(t)
                got = count_text(t, spans, enc)
                out["n_tokens"].append(int(got["by_start"].sum()) if sections is line_sections else len(enc.encode(t)))
                out["sections"].append([{"section": i, "start_char": a, "end_char": b, "n_tokens": int(n), "n_by_end": int(m), "token_share": float(s), "n_crossing": int(c)}
                                        for i, ((a, b), n, m, s, c) in enumerate(zip(spans, got["by_start"], got["by_end"], got["share"], got["crossing"]))])
            return out
        return f

    return with_text_column(df, text, make, "n_tokens long, sections array<struct<section: int, start_char: bigint, end_char: bigint, n_tokens: bigint, n_by_end: bigint, token_share: double, n_crossing: bigint>>")


def count_documents(docs: DataFrame) -> DataFrame:
    """One row per line of every document: doc_id, section, start_char, end_char, n_tokens, n_by_end, token_share,
    n_crossing, doc_tokens."""
    x = with_section_counts(docs.select("doc_id", "text"))
    return x.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode("sections").alias("s")).select("doc_id", "s.*", "doc_tokens")
