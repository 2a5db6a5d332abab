"""Byte-level BPE ids for whole texts: the vocabulary of a ``tokenizers`` file, encoded by its faster twin where possible."""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

import numpy as np

#: Longest run without (or of) white space that is left to the fast encoder.
LONG_RUN = 2000


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does.

    ``tiktoken`` with the ranks of the same merges gives the same ids several times faster; texts with very long runs,
    whose cost there grows with the square of the run, go to ``tokenizers``. The tests compare both.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        to_byte = {c: b for b, c in byte_letters().items()}
        size = max(max(vocab.values()), max(added.values(), default=0)) + 1
        self.bytes_of = np.zeros(size, np.int64)
        ranks = {}
        for word, i in vocab.items():
            if word in added:
                self.bytes_of[i] = len(word.encode())
            else:
                ranks[bytes(to_byte[c] for c in word)] = i
                self.bytes_of[i] = len(word)
        for word, i in added.items():
            self.bytes_of[i] = len(word.encode())
        import public_tokenizers
        import tiktoken

        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @cached_property
    def exact(self):
        """The ``tokenizers`` encoder, loaded when first needed."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str, end_id: int | None = None) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers, with ``end_id`` behind them if given. Lone surrogates count as "?"."""
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-8", "replace").decode()
        if has_long_run(text):
            found = np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        return found if end_id is None else np.append(found, np.uint32(end_id))


def has_long_run(text: str) -> bool:
    """Whether more than LONG_RUN characters stand together without, or as the same, white space. A run of that length
    covers a whole block of half of it, so only texts with such a block are split."""
    step = LONG_RUN // 2
    if len(text) <= LONG_RUN:
        return False
    bare = any(" " not in text[i: i + step] for i in range(0, len(text) - step + 1, step))
    return bare and max(map(len, text.split()), default=0) > LONG_RUN or any(c * LONG_RUN in text for c in " \n\t\r")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
