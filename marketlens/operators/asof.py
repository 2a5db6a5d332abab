"""As-of joins: backward, forward, last-n, with tolerance.

Both sides are unioned and the newest right row is carried forward, inside (key, time chunk) by a
window and between chunks by one row per chunk. A hot key is split by time and no pairs of rows are
ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import epoch_us, int_div
from .ordered import CHUNK, add_chunk, balanced_chunks, block_window, lookback, own_rows


def _asof(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
          take: dict[str, str], width_s: float | None, sign: int, tolerance_s: float | None, strict: bool,
          right_tie: Sequence[str]) -> DataFrame:
    on = list(on)
    lkeys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    keys = [f"_k{i}" for i in range(len(on))]
    # Right rows sort before left rows at equal time, unless equality is excluded.
    side_right, side_left = (1, 0) if strict else (0, 1)
    payload = F.struct(epoch_us(right_ts).alias("_rt"), *[F.col(src).alias(dst) for dst, src in take.items()])
    tie = F.struct(*[F.col(x) for x in right_tie]) if right_tie else F.struct(F.lit(0).alias("z"))
    rhs = right.select(*lkeys, (epoch_us(right_ts) * sign).alias("_t"), F.lit(side_right).alias("_side"),
                       tie.alias("_tie"), payload.alias("_r"))
    lhs = left.select(*lkeys, (epoch_us(left_ts) * sign).alias("_t"), F.lit(side_left).alias("_side"),
                      F.struct(*[F.col(x) for x in left.columns]).alias("_l"))
    # A right row without a key or a time matches nothing; such left rows stay, without a match.
    for x in [*keys, "_t"]:
        rhs = rhs.where(F.col(x).isNotNull())
    part, order = [*keys, CHUNK], ["_t", "_side", "_tie"]
    if width_s is None:  # chunks of equal row counts, written once
        both = balanced_chunks(rhs.unionByName(lhs, allowMissingColumns=True), keys, order)
        rhs, lhs = both.where(F.col("_side") == side_right).drop("_l"), both.where(F.col("_side") == side_left).drop("_r", "_tie")
    else:
        width = int(width_s * 1_000_000)
        chunk = F.floor(F.col("_t") / width) if sign < 0 else int_div("_t", width)
        rhs, lhs = rhs.withColumn(CHUNK, chunk), lhs.withColumn(CHUNK, chunk)
    # Newest right row of every chunk, and the chunks that hold left rows. Only key columns of the left
    # side are read here, so a chain of as-of joins does not compute its input twice per link.
    seen = rhs.groupBy(*part).agg(F.max_by("_r", F.struct(*order)).alias("_c")).unionByName(
        lhs.select(*part).distinct(), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.groupBy(*part).agg(F.first("_c", True).alias("_c")).select(*part, F.last("_c", True).over(before).alias("_carry"))
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rhs.unionByName(lhs, allowMissingColumns=True).withColumn("_in", F.last("_r", True).over(local))
    got = both.where(F.col("_side") == side_left).join(carry, part, "left").withColumn("_hit", F.coalesce("_in", "_carry"))
    ok = F.lit(True)
    if tolerance_s is not None:
        ok = F.abs(F.col("_hit._rt") - F.col("_t") * sign) <= int(tolerance_s * 1_000_000)
    return got.select("_l.*", *[F.when(ok, F.col(f"_hit.{d}")).alias(d) for d in take])


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], *, left_ts: str, right_ts: str,
                  take: dict[str, str], width_s: float | None = 86_400, tolerance_s: float | None = None,
                  strict: bool = False, right_tie: Sequence[str] = ()) -> DataFrame:
    """Every left row with the newest right row at or before it (``strict``: before it).

    ``take`` maps output names to right columns; a left row without a match gets nulls. Chunks span ``width_s`` seconds, or hold
    equally many rows (None), so that neither a hot key nor a dense day lies in one task.
    ``right_tie`` orders right rows of equal time (the last one wins).
    """
    return _asof(left, right, on, left_ts, right_ts, take, width_s, 1, tolerance_s, strict, right_tie)


def asof_forward(left: DataFrame, right: DataFrame, on: Sequence[str], *, left_ts: str, right_ts: str,
                 take: dict[str, str], width_s: float | None = 86_400, tolerance_s: float | None = None,
                 strict: bool = False, right_tie: Sequence[str] = ()) -> DataFrame:
    """Every left row with the first right row at or after it; null means "not there yet".

    With ``right_tie`` the row latest in that order wins among right rows of equal time.
    """
    return _asof(left, right, on, left_ts, right_ts, take, width_s, -1, tolerance_s, strict, right_tie)


def asof_last_n(left: DataFrame, bars: DataFrame, on: Sequence[str], n: int, *, left_ts: str, bar_ts: str,
                value: str, out: str, width_s: float = 86_400, block: int = 65_536) -> DataFrame:
    """Every left row with the array of the last ``n`` bar values at or before it (oldest first)."""
    with_arr = own_rows(lookback(bars.select(*on, bar_ts, value), on, [bar_ts], n - 1, ts=bar_ts,
                                 width_s=width_s, block=block).withColumn(
        out, F.collect_list(value).over(block_window(on).rowsBetween(-(n - 1), 0))))
    return asof_backward(left, with_arr, on, left_ts=left_ts, right_ts=bar_ts, take={out: out}, width_s=width_s)


def asof_window(left: DataFrame, ticks: DataFrame, on: Sequence[str], *, left_ts: str, tick_ts: str,
                before_s: float, after_s: float, take: dict[str, str], width_s: float = 86_400) -> DataFrame:
    """First tick inside [left - before, left + after]; null when there is none."""
    shifted = left.withColumn("_from", F.timestamp_micros(epoch_us(left_ts) - int(before_s * 1_000_000)))
    return asof_forward(shifted, ticks, on, left_ts="_from", right_ts=tick_ts, take=take, width_s=width_s,
                        tolerance_s=before_s + after_s).drop("_from")


def open_price_resolve(rounds: DataFrame, reference: DataFrame, oracle: DataFrame, *, width_s: float = 86_400
                       ) -> DataFrame:
    """Open price of each round: venue reference, else first oracle round at or after start.

    ``rounds`` has (condition_id, asset, start_ts); ``reference`` (condition_id, ref_price) is unique
    per market. Adds ``open_price`` and ``open_src`` (``PM``, ``CL-exact`` or ``not-ready``). A
    reference that arrives later simply wins on the next run.
    """
    with_oracle = asof_forward(rounds, oracle, ["asset"], left_ts="start_ts", right_ts="updated_at",
                               take={"_oracle": "price"}, width_s=width_s)
    got = with_oracle.join(reference.where(F.col("ref_price") > 0), "condition_id", "left")
    return got.withColumns({
        "open_price": F.coalesce("ref_price", "_oracle"),
        "open_src": F.when(F.col("ref_price").isNotNull(), "PM").when(F.col("_oracle").isNotNull(), "CL-exact")
                     .otherwise("not-ready"),
    }).drop("ref_price", "_oracle")


def market_token_price(token_prices: DataFrame, rounds: DataFrame) -> DataFrame:
    """Token quotes as the round's Up price (a Down token quotes 1 - p)."""
    tokens = rounds.select("condition_id", F.posexplode("tokens").alias("_pos", "token_id")).where("_pos < 2")
    return (token_prices.where(F.col("price") > 0).join(tokens, "token_id")
            .select("condition_id", "ts", F.when(F.col("_pos") == 0, F.col("price"))
                    .otherwise(1 - F.col("price")).alias("up_price")))


@dataclass(frozen=True)
class Source:
    """One right side of ``asof_many``: its rows, their time, what to take (output name -> column), the longest age of a match in
    seconds (None: any), and the columns that order rows of equal time (the last one wins)."""

    rows: DataFrame
    ts: str
    take: Mapping[str, str]
    tolerance_s: float | None = None
    tie: Sequence[str] = ()


def asof_many(left: DataFrame, sources: Sequence[Source], on: Sequence[str], *, left_ts: str, width_s: float | None = None) -> DataFrame:
    """Every left row with the newest row of each source at or before it: all sides in one union and one order.

    A chain of as-of joins moves the left rows once per source; here they move once, whatever the number of sources, and each
    source is one carried column set. Chunks hold equally many rows (``width_s`` None), so neither a hot key nor a
    dense day lies in one task, or span ``width_s`` seconds. A source row without a key or a time matches nothing; a left row
    without one stays and gets nulls; repeated left rows stay repeated.
    """
    on, keys = list(on), [f"_k{i}" for i in range(len(on))]
    lkeys = [F.col(k).alias(n) for k, n in zip(on, keys)]
    sets = [f"_r{i}" for i in range(len(sources))]
    ties = [f"_tie{i}" for i, x in enumerate(sources) if x.tie]
    both = left.select(*lkeys, epoch_us(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(x) for x in left.columns]).alias("_l"))
    for i, x in enumerate(sources):
        tie = [F.struct(*[F.col(c) for c in x.tie]).alias(f"_tie{i}")] if x.tie else []
        row = F.struct(epoch_us(x.ts).alias("_at"), *[F.col(c).alias(n) for n, c in x.take.items()]).alias(f"_r{i}")
        rows = x.rows.select(*lkeys, epoch_us(x.ts).alias("_t"), F.lit(0).alias("_side"), *tie, row)
        for c in [*keys, "_t"]:
            rows = rows.where(F.col(c).isNotNull())
        both = both.unionByName(rows, allowMissingColumns=True)
    order = ["_t", "_side", *ties]
    both = balanced_chunks(both, keys, order) if width_s is None else add_chunk(both.withColumn("_ts", F.timestamp_micros("_t")), "_ts", width_s).drop("_ts")
    part = [*keys, CHUNK]
    newest = both.groupBy(*part).agg(*[F.max_by(r, F.when(F.col(r).isNotNull(), F.struct(*order))).alias(r) for r in sets])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = newest.select(*part, *[F.last(r, True).over(before).alias(f"_c{r}") for r in sets])
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(*part, "_t", "_side", "_l", *[F.last(r, True).over(local).alias(r) for r in sets]).where("_side = 1")
    out = seen.join(carry, part, "left")
    taken = []
    for r, x in zip(sets, sources):
        hit = F.coalesce(r, f"_c{r}")
        ok = hit["_at"] <= F.col("_t") if x.tolerance_s is None else F.col("_t") - hit["_at"] <= int(x.tolerance_s * 1_000_000)
        taken += [F.when(ok, hit[n]).alias(n) for n in x.take]
    return out.select("_l.*", *taken)
