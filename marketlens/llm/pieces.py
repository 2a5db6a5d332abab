"""Sentence-piece ids of whole texts through a table of distinct marked words, and back.

Where no piece holds a marker behind another letter, merges never cross from a word into the next marker, so a text is cut
into marked words (a run of markers and what follows up to the next one) that are segmented apart. Each distinct marked word
is segmented once, and its ids are joined back by position:

1. a task cuts its texts into blocks and replaces marked words by codes; a block keeps its codes in order of position and
   sends its distinct words to buckets by hash;
2. a bucket is one share of the table of distinct words: it segments each of its words once, whoever sent it;
3. ids return to their block, where every position takes the ids of its code.

A frequent word comes once per block and bucket, so no key is hot, and texts themselves are never moved.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import bounded_batches

#: Bytes of text of a block (a longer text is a block of its own), codes in one row of it, and bytes of text whose distinct
#: words share a bucket.
BLOCK, PIECE, SHARE = 12 << 20, 1 << 18, 64 << 20
#: Stands between words of a row: no byte of UTF-8.
STOP = b"\xff"
CODES, WORDS, ROW = 0, 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(model: str):
    """The library's processor, one per worker process; raises where words of this model can't be segmented apart."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(model, "rb") as f:
        spec.ParseFromString(f.read())
    rules = spec.normalizer_spec
    crossing = any("▁" in p.piece.lstrip("▁") for p in spec.pieces if p.type == p.NORMAL)
    if crossing or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix \
            or spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("pieces of this model can cross whitespace markers")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if sp.piece_to_id("▁") == sp.unk_id():
        raise ValueError("the marker is no piece of this model")
    return sp


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Marked words of all texts as bytes, without their first marker and with spaces for others, and how many each text has.
    Null and empty: none."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    count = np.zeros(len(size), np.int64)
    some = pc.replace_substring(texts.filter(pa.array(size > 0)), "▁", " ").cast(pa.binary())
    odd = pc.or_(pc.match_substring(some, b"  "), pc.or_(pc.starts_with(some, b" "), pc.ends_with(some, b" ")))
    even = pc.invert(odd)
    # runs of spaces: only the space behind another letter parts two words
    lists = pa.concat_arrays([pc.split_pattern(some.filter(even), b" "), pc.split_pattern(
        pc.replace_substring_regex(some.filter(odd), pattern=b"([^ ]) ", replacement=b"\\1" + STOP), STOP)])
    if pc.any(odd).as_py():
        lists = lists.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(even), np.flatnonzero(odd)]), kind="stable")))
    count[size > 0] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), count


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of their used low bytes."""
    flat = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([used]) + zstandard.compress(flat[:, :used].T.tobytes(), 3)


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :blob[0]] = planes.T
    return out.view("<i4").ravel()


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, *, model: str | None = None, into: str = "ids",
           block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """The columns ``keep`` of ``df`` (None: all) and ``into`` array<int>: ids of the whole text with begin and end ids.

    One row per row of ``df``: repeated rows and null ids are rows like others; a null text counts as empty and has the
    begin and end ids alone; an empty table gives no rows; a column of ``keep`` named as ``into`` is replaced. ``df`` must
    give the same rows again when a task is repeated, as files and checkpoints do.
    """
    spark, model = df.sparkSession, model or default_model()
    bounded_batches(spark)
    processor(model)
    keep = [c for c in (df.columns if keep is None else keep) if c != into]
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = int(size // share) + 1
    row = StructType([StructField(c, df.schema[c].dataType) for c in keep])
    src = df.select(F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.lit(0).alias("row"), F.col(text).cast("string").alias("text"))
    if not keep:
        row = src.schema["row"].dataType
    wire = StructType.fromDDL("to long, kind int, block long, at int, n int, blob binary").add("row", row, True)
    made = src.mapInArrow(lambda batches: _cut(batches, buckets, block), wire)
    found = made.repartition("to").sortWithinPartitions("to").mapInArrow(lambda batches: _segment(batches, model), wire)
    out = StructType([StructField("row", row, True), StructField(into, ArrayType(IntegerType()))])
    begin, end = processor(model).bos_id(), processor(model).eos_id()
    whole = found.groupBy("block").applyInArrow(lambda t: _rebuild(t, begin, end, into), out)
    return whole.select(*[F.col("row")[c].alias(c) for c in keep], into)


def _cut(batches: Iterator[pa.RecordBatch], buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seq, rows, texts, size, kind = TaskContext.get().partitionId() << 32, 0, [], [], 0, None
    for batch in batches:
        kind = batch.schema.field("row").type
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lengths):
            ends = size + np.cumsum(lengths[at:])
            stop = at + max(int(np.searchsorted(ends, limit, "right")), 0 if texts else 1)
            if stop > at:
                rows.append(batch["row"].slice(at, stop - at))
                texts.append(batch["text"].slice(at, stop - at))
                size += int(lengths[at:stop].sum())
            if stop < len(lengths):
                yield from _block(base + seq, rows, texts, buckets, kind)
                seq, rows, texts, size = seq + 1, [], [], 0
                pa.default_memory_pool().release_unused()
            at = stop
    if texts:
        yield from _block(base + seq, rows, texts, buckets, kind)


def _wire(to, kind, block, at, n, blob, row, row_type) -> Iterator[pa.RecordBatch]:
    k = len(to)
    cols = [pa.array(to, pa.int64()), pa.array(np.full(k, kind), pa.int32()), pa.array(np.full(k, block), pa.int64()), pa.array(at, pa.int32()),
            pa.array(n, pa.int32()), pa.array(blob, pa.binary()) if blob is not None else pa.nulls(k, pa.binary()),
            row if row is not None else pa.nulls(k, row_type)]
    yield pa.RecordBatch.from_arrays(cols, ["to", "kind", "block", "at", "n", "blob", "row"])


def _block(block: int, rows: list, texts: list, buckets: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of one block: its documents, the codes by position, and its distinct words by bucket."""
    found = [marked_words(t) for t in texts]
    rows, count = pa.concat_arrays(rows), np.concatenate([c for _, c in found])
    coded = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    home = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    # frequent words get small codes, equally frequent ones lie by bucket and letters: both pack well
    table = pa.table({"uses": np.bincount(codes, minlength=len(home)), "home": home, "word": coded.dictionary})
    order = pc.sort_indices(table, [("uses", "descending"), ("home", "ascending"), ("word", "ascending")]).to_numpy()
    code_of = np.empty(len(order), np.int32)
    code_of[order] = np.arange(len(order))
    codes, home, words = code_of[codes], home[order], coded.dictionary.take(pa.array(order)).to_pylist()
    del found, coded, table
    away = -1 - zlib.crc32(str(block).encode())
    yield from _wire(np.full(len(count), away), ROW, block, np.arange(len(count)), count, None, rows, kind)
    pieces = [squeeze(codes[i: i + PIECE]) for i in range(0, len(codes), PIECE)]
    homes = [squeeze(home[i: i + PIECE]) for i in range(0, len(home), PIECE)]
    blobs = [*pieces, *homes]
    yield from _wire(np.full(len(blobs), away), CODES, block, [*range(len(pieces)), *(-1 - i for i in range(len(homes)))],
                     np.full(len(blobs), len(words)), blobs, None, kind)
    order = np.argsort(home, kind="stable")
    used, starts = np.unique(home[order], return_index=True)
    ends = [*starts[1:], len(order)]
    packed = [zstandard.compress(STOP.join([words[i] for i in order[a:b]]), 3) for a, b in zip(starts, ends)]
    for i in range(0, len(used), 256):
        yield from _wire(used[i: i + 256], WORDS, block, used[i: i + 256], [b - a for a, b in zip(starts[i: i + 256], ends[i: i + 256])],
                         packed[i: i + 256], None, kind)


def _segment(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of each row; other rows pass. Rows come by bucket: a word of a bucket is segmented once."""
    sp, now, table = processor(model), None, {}
    single = np.array([sp.piece_to_id("▁")], np.int32)
    for batch in batches:
        kinds, tos, blobs = batch["kind"].to_numpy(), batch["to"].to_numpy(), batch["blob"]
        if (kinds == WORDS).any():
            made = []
            for kind, to, blob in zip(kinds, tos, blobs):
                blob = blob.as_py()
                if kind == WORDS:
                    if to != now:
                        now, table = to, {b"": single}
                    words = zstandard.decompress(blob).split(STOP)
                    fresh = [w for w in words if w not in table]
                    table.update(zip(fresh, (np.array(x, np.int32) for x in sp.encode([w.decode("utf-8", "replace") for w in fresh]))))
                    ids = [table[w] for w in words]
                    lengths = squeeze(np.fromiter(map(len, ids), np.int64, len(ids)))
                    blob = len(lengths).to_bytes(4, "little") + lengths + squeeze(np.concatenate(ids))
                made.append(blob)
            batch = batch.set_column(batch.schema.get_field_index("blob"), "blob", pa.array(made, pa.binary()))
        yield batch


def _rebuild(t: pa.Table, begin: int, end: int, into: str) -> pa.Table:
    """Rows of one block with their ids: each position takes the ids of its code."""
    kind, at, n = (t[c].to_numpy() for c in ("kind", "at", "n"))

    def blobs(which: np.ndarray, order: np.ndarray) -> list[bytes]:
        return t["blob"].take(which[np.argsort(order[which])]).to_pylist()

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    docs = np.flatnonzero(kind == ROW)
    docs = docs[np.argsort(at[docs])]
    codes = joined([unsqueeze(b) for b in blobs(np.flatnonzero((kind == CODES) & (at >= 0)), at)])
    home = joined([unsqueeze(b) for b in blobs(np.flatnonzero((kind == CODES) & (at < 0)), -at)])
    lengths, ids = [], []
    for b in blobs(np.flatnonzero(kind == WORDS), at):
        k = 4 + int.from_bytes(b[:4], "little")
        lengths.append(unsqueeze(b[4:k]))
        ids.append(unsqueeze(b[k:]))
    lengths, ids = joined(lengths), joined(ids)
    if len(lengths) != len(home):
        raise RuntimeError("a block lost words: the input changed between tasks")
    by_code = np.argsort(home, kind="stable")  # words came back by bucket, within it by code
    start, length = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
    length[by_code], start[by_code] = lengths, np.cumsum(lengths, dtype=np.int64) - lengths
    word_end = np.concatenate([[0], np.cumsum(length[codes])])[np.cumsum(n[docs], dtype=np.int64)]
    offsets = np.concatenate([[0], np.cumsum(np.diff(word_end, prepend=0) + 2)])
    out = np.empty(offsets[-1], np.int32)
    out[offsets[:-1]], out[offsets[1:] - 1] = begin, end
    a = 0
    for first, last, words in zip(offsets[:-1], offsets[1:], n[docs]):  # one text at a time: places of all ids need several arrays
        own = codes[a: a + words]
        each, a = length[own], a + words
        out[first + 1: last - 1] = ids[np.repeat(start[own] - np.cumsum(each) + each, each) + np.arange(last - first - 2)]
    ids_col = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
    return pa.table({"row": t["row"].take(docs), into: ids_col})


def _ids(batch: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of a batch one by one, so that no batch of them becomes Python integers at once."""
    flat, ends = batch.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for known, end, size in zip(batch.is_valid().to_pylist(), ends, np.diff(ends, prepend=0)):
        yield flat[end - size: end] if known else None


def decode(ids: str, *, model: str | None = None) -> Column:
    """From an id list (array<int>) a struct of the library's ``text`` and ``sha256``, lowercase hex, of the ids as little-endian
    unsigned 32-bit integers. A null list: nulls; no ids: the empty text."""
    model = model or default_model()
    kind = pa.struct([("text", pa.string()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = processor(model)
        for batch in batches:
            out = [None if x is None else {"text": sp.decode(x.tolist()), "sha256": hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()} for x in _ids(batch)]
            yield pa.array([x or {"text": None, "sha256": None} for x in out], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="text string, sha256 string")(F.col(ids))


def digest_documents(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; nulls and repeated rows as in ``encode``."""
    bounded_batches(docs.sparkSession)
    back = encode(docs, "text", ["doc_id"], model=model).withColumn("back", decode("ids", model=model))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.col("back.sha256").alias("ids_sha256"),
                       F.sha2(F.col("back.text").cast("binary"), 256).alias("decoded_sha256"))
