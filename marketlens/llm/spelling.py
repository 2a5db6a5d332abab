"""Spelling variants: words that differ by one code point, found by pivotal bigrams.

Bigrams are ordered by how many words hold them, rare ones first. The first three places of a word in that order hold two
bigrams that do not overlap; a dynamic program chooses the rarest two as its pivots. One inserted, deleted or replaced code
point touches at most one of them, so the other one survives in a near word. If the near word's prefix (its bigrams up to its
third place, ties included) ends at the same place of the order or later, the pivot lies in that prefix; else the roles are
swapped. The change lies wholly behind or wholly before the surviving pivot, so either the offset from the start and all
before it agree, or the offset from the end and all behind it: pivots and prefixes meet on that part of the word, and the
pairs that meet are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

RUN = "[a-zÀ-ÿ]+"
#: Shortest word and fewest occurrences; a form is at least DOMINANT times as frequent; one run in TYPO loses a code point.
LETTERS, OCCURRENCES, DOMINANT, TYPO = 5, 3, 2, 97
#: Places of a prefix and changes allowed: 2 * 1 + 1 bigrams hold two that do not overlap.
PLACES = 3
#: Distinct words of a task that are counted before they are passed on.
HELD = 1 << 18


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters of whole texts, A-Z lower-cased, with one code point gone where 97 divides the CRC-32
    of ``<doc_id>:<run>``. A null text has no run; a null id deletes nothing. Runs are counted within a task first."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(RUN).findall, Counter()
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if t is None:
                    continue
                runs = Counter(find(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if i is not None:
                    start = zlib.crc32(f"{i}:".encode())
                    for run in [r for r in runs if zlib.crc32(r.encode(), start) % TYPO == 0]:
                        at = zlib.crc32(run.encode(), start) % len(run)
                        n = runs.pop(run)
                        held[run[:at] + run[at + 1:]] += n
                for run, n in runs.items():
                    held[run] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    src = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def grams(word: Column) -> Column:
    """All bigrams of a word with their places from 0."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct((i - 1).alias("at"), F.substring(word, i, F.lit(2)).alias("gram")))


def pivots(places: Column) -> Column:
    """The two bigrams of ``places`` (array of (at, gram, uses) in order of ``at``) that do not overlap and have the fewest uses
    together; ties: the leftmost. One pass: the best single bigram that ended before, and the best pair so far."""
    one = "struct<uses:bigint,at:int,gram:string>"
    two = "struct<uses:bigint,a:struct<at:int,gram:string>,b:struct<at:int,gram:string>>"
    start = F.struct(F.lit(None).cast(one).alias("before"), F.lit(None).cast(one).alias("last"), F.lit(None).cast(two).alias("pair"))

    def step(s: Column, p: Column) -> Column:
        # ``last`` is the bigram before this one and may overlap it; ``before`` is the best of all earlier ones, which can't
        free = F.when(s["last"]["at"] < p["at"] - 1, F.least(s["before"], s["last"])).otherwise(s["before"])
        pair = F.when(free.isNotNull(), F.struct((free["uses"] + p["uses"]).alias("uses"), F.struct(free["at"].alias("at"), free["gram"].alias("gram")).alias("a"),
                                                 F.struct(p["at"].alias("at"), p["gram"].alias("gram")).alias("b")))
        now = F.struct(p["uses"].alias("uses"), p["at"].alias("at"), p["gram"].alias("gram"))
        return F.struct(F.least(s["before"], s["last"]).cast(one).alias("before"), now.cast(one).alias("last"),
                        F.least(s["pair"], pair).cast(two).alias("pair"))

    return F.aggregate(places, start, step, lambda s: F.array(s["pair"]["a"], s["pair"]["b"]))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ``words`` (word, distinct, at least LETTERS code points) that differ by exactly one inserted,
    deleted or replaced code point."""
    spread = words.select("word", F.explode(grams(F.col("word"))).alias("g")).select("word", "g.at", "g.gram")
    # at most as many rows as pairs of letters of the alphabet: 90 * 90
    uses = spread.groupBy("gram").agg(F.countDistinct("word").alias("uses"))
    ranked = F.struct("uses", "gram", "at")
    known = words.select("word", F.posexplode(grams(F.col("word"))).alias("i", "g")).select("word", "g.at", "g.gram").join(F.broadcast(uses), "gram")
    lists = known.groupBy("word").agg(F.sort_array(F.collect_list(ranked)).alias("order"))  # a word's own bigrams
    lists = lists.withColumn("third", F.element_at("order", PLACES)).withColumn("third", F.struct(F.col("third.uses").alias("uses"), F.col("third.gram").alias("gram")))
    by_place = F.array_sort(F.transform(F.slice("order", 1, PLACES), lambda p: F.struct(p["at"].alias("at"), p["gram"].alias("gram"), p["uses"].alias("uses"))))
    prefix = F.transform(F.filter("order", lambda p: F.struct(p["uses"].alias("uses"), p["gram"].alias("gram")) <= F.col("third")), lambda p: p["at"])
    lists = written(lists.select("word", "third", F.transform(pivots(by_place), lambda p: p["at"]).alias("pivots"), prefix.alias("prefix")))

    def entries(places: str) -> DataFrame:
        rows = lists.select("word", "third", F.explode(places).alias("at"))
        ahead, behind = F.expr("substring(word, 1, at + 2)"), F.expr("substring(word, at + 1)")
        return rows.select("word", "third", F.explode(F.array(F.struct(F.lit(0).alias("side"), ahead.alias("part")), F.struct(F.lit(1).alias("side"), behind.alias("part")))).alias("k")).select(
            "word", "third", "k.side", "k.part", F.length("word").alias("size"))

    left = entries("pivots").select(F.col("word").alias("a"), F.col("third").alias("ta"), "side", "part", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)).alias("size"))
    right = entries("prefix").select(F.col("word").alias("b"), F.col("third").alias("tb"), "side", "part", "size")
    met = left.join(right, ["side", "part", "size"]).filter((F.col("ta") <= F.col("tb")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forms(counted: DataFrame) -> DataFrame:
    """One row per word of ``counted`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least DOMINANT times the
    word's; root follows forms to the last. Rows with a null word are left out; an empty table gives no rows.
    """
    words = written(counted.filter(F.length("word") >= LETTERS).select("word", "n"))
    pairs = written(near_pairs(words.select("word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the largest n first, then the smallest word: max over n, min over the word among those
    best = (both.join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b").groupBy("a")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("m"), F.col("b").alias("b"))).alias("best")).withColumnRenamed("a", "word"))
    linked = words.join(best, "word", "left").withColumn("ok", F.coalesce(-F.col("best.m") >= DOMINANT * F.col("n"), F.lit(False)))
    linked = written(linked.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("best.b")).alias("form"),
                                   F.when(F.col("ok"), -F.col("best.m")).alias("form_n")))
    # n at least doubles along forms, so chains have at most 63 steps and each round halves what is left of them
    roots = linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(ahead, "root", "left"))
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.filter("next IS NOT NULL").isEmpty():
            break
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spelling variants of all words of ``docs``: ``count_words`` of at least OCCURRENCES occurrences, then ``forms``.
    Repeated rows count again; other columns are not read."""
    return forms(count_words(docs, doc_id, text).filter(F.col("n") >= OCCURRENCES))


#: The result in DuckDB: all pairs of words by edit distance, over letters mapped to one byte each; CRC-32 bit by bit.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~"[:64]
TWIN = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
                        FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT doc_id, run, k, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM counted),
crc AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1),
               lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, byte: list_reduce(list_prepend(xor(c, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
               lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM hashed),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM crc),
words AS (SELECT word, sum(k)::BIGINT AS n, translate(word, '{_ACCENTED}', '{_ONE_BYTE}') AS w FROM typed
          WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(k) >= {OCCURRENCES}),
near AS (SELECT a.word, b.word AS other, b.n FROM words AS a JOIN words AS b ON length(b.w) BETWEEN length(a.w) - 1 AND length(a.w) + 1
         WHERE a.word <> b.word AND levenshtein(a.w, b.w) = 1),
best AS (SELECT word, count(*) AS n_near, max(n) AS bn FROM near GROUP BY word),
form AS (SELECT near.word, min(other) AS form, any_value(n_near) AS n_near, any_value(bn) AS bn FROM near JOIN best ON best.word = near.word AND best.bn = near.n GROUP BY near.word),
linked AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= {DOMINANT} * words.n THEN form END AS form,
                  CASE WHEN bn >= {DOMINANT} * words.n THEN bn END AS form_n FROM words LEFT JOIN form ON form.word = words.word),
chain AS (SELECT word, word AS root FROM linked UNION ALL SELECT chain.word, linked.form FROM chain JOIN linked ON linked.word = chain.root WHERE linked.form IS NOT NULL),
roots AS (SELECT chain.word, chain.root FROM chain JOIN linked ON linked.word = chain.root WHERE linked.form IS NULL)
SELECT linked.word, form, root, n, n_near, form_n FROM linked JOIN roots ON roots.word = linked.word
"""
