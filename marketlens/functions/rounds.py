"""Round windows: exactness, keys, titles, effective ends, decision prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, c

# Title pattern of a round, "February 21, 8:30AM-8:45AM ET".
TITLE_PATTERN = r"([A-Za-z]+)\s+(\d{1,2}),\s*(\d{1,2}:\d{2})(AM|PM)?-(\d{1,2}:\d{2})(AM|PM)\s*ET"
TITLE_ZONE = "America/New_York"


def is_exact_round(start_s: ColumnOrName, end_s: ColumnOrName, minutes: ColumnOrName) -> Column:
    """True when a window has the exact length and sits on the minute grid.

    Times are epoch seconds (double); the length may be off by at most 2.5 s.
    """
    st, en, dur = c(start_s).cast("double"), c(end_s).cast("double"), c(minutes).cast("bigint")
    sec = lambda t: F.floor(t) % 60
    minute = lambda t: F.floor(t / 60.0) % 60
    on_grid = F.when(dur.isin(5, 15), (minute(st) % dur == 0) & (minute(en) % dur == 0)).otherwise(F.lit(True))
    good = ((st > 0) & (en > 0) & (dur > 0)
            & (F.abs((en - st) - dur * 60.0) <= 2.5)
            & (sec(st) == 0) & (sec(en) == 0) & on_grid)
    return F.coalesce(good, F.lit(False))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` names it: a column named twice is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _title_bounds(title: ColumnOrName, year: int | ColumnOrName) -> Column:
    """Struct (st, en) of a title's bounds, both null when unreadable; the title is matched once."""
    y = F.lit(year) if isinstance(year, int) else c(year)
    found = F.regexp_extract(c(title), TITLE_PATTERN, 0)
    groups = F.split(F.regexp_replace(found, TITLE_PATTERN, "$1,$2,$3,$4,$5,$6"), ",")

    def instant(g: Column, t: int, ap: Column) -> Column:
        text = F.concat_ws(" ", y.cast("string"), F.initcap(F.get(g, F.lit(0))), F.get(g, F.lit(1)), F.concat(F.get(g, F.lit(t)), ap))
        local = F.try_to_timestamp(text, F.lit("yyyy MMMM d h:mma"))
        return F.unix_micros(F.to_utc_timestamp(local, TITLE_ZONE)) / 1e6

    def read(g: Column) -> Column:
        ok, ap1, ap2 = F.size(g) == 6, F.get(g, F.lit(3)), F.get(g, F.lit(5))
        return F.struct(F.when(ok, instant(g, 2, F.when(ap1 == "", ap2).otherwise(ap1))).alias("st"), F.when(ok, instant(g, 4, ap2)).alias("en"))

    def ordered(x: Column) -> Column:
        both = x["st"].isNotNull() & x["en"].isNotNull()
        return F.struct(F.when(both, x["st"]).alias("st"), F.when(both, F.when(x["en"] <= x["st"], x["st"] + 86400.0).otherwise(x["en"])).alias("en"))

    return _once(_once(groups, read), ordered)


def bounds_from_title(title: ColumnOrName, year: int | ColumnOrName) -> tuple[Column, Column]:
    """(start, end) epoch seconds from an Eastern-time title; nulls when unreadable.

    Titles carry no year, so it is a parameter. A first time without AM/PM takes the second
    one's; an end at or before the start is moved to the next day.
    """
    b = _title_bounds(title, year)
    return b["st"], b["en"]


def window_from_title(title: ColumnOrName, minutes: ColumnOrName, start_s: ColumnOrName,
                      end_s: ColumnOrName, year: int | ColumnOrName, *,
                      expired_before_s: ColumnOrName | None = None) -> tuple[Column, Column]:
    """Window replaced by the title's where the title is exact.

    With ``expired_before_s`` only titles that ended by then replace the stored window.
    """
    def judged(b: Column) -> Column:
        use = is_exact_round(b["st"], b["en"], minutes)
        if expired_before_s is not None:
            use = use & (b["en"] <= c(expired_before_s))
        return F.when(use, b)

    b = _once(_title_bounds(title, year), judged)
    return F.when(b.isNotNull(), b["st"]).otherwise(c(start_s)), F.when(b.isNotNull(), b["en"]).otherwise(c(end_s))


def _window_key(asset: Column, dur: Column, st: Column, en: Column) -> Column:
    stamp = lambda t: F.date_format(F.timestamp_seconds(F.floor(t)), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(asset, F.lit("-"), dur.cast("string"), F.lit("m-"), stamp(st), F.lit("-"), stamp(en))


def _exact_window(minutes: Column, start_s: Column, end_s: Column, title: ColumnOrName | None,
                  year: int | ColumnOrName | None) -> tuple[Column, Column, Column, Column]:
    exact = is_exact_round(start_s, end_s, minutes)
    if title is None or year is None:
        return minutes, start_s, end_s, exact

    def judged(b: Column) -> Column:
        q_dur = F.round((b["en"] - b["st"]) / 60.0).cast("bigint")
        dur = F.when(~exact & (minutes <= 0) & q_dur.isin(5, 15), q_dur).otherwise(minutes)
        by_title = ~exact & is_exact_round(b["st"], b["en"], dur)
        return F.struct(dur.alias("dur"), F.when(by_title, b["st"]).otherwise(start_s).alias("st"),
                        F.when(by_title, b["en"]).otherwise(end_s).alias("en"), (exact | by_title).alias("exact"))

    w = _once(_title_bounds(title, year), judged)
    return w["dur"], w["st"], w["en"], w["exact"]


def round_key(asset: ColumnOrName, minutes: ColumnOrName, start_s: ColumnOrName, end_s: ColumnOrName,
              cid: ColumnOrName, title: ColumnOrName | None = None,
              year: int | ColumnOrName | None = None) -> Column:
    """``ASSET-15m-start-end``; falls back to the market id, in full: a shortened one would merge markets."""
    a = F.upper(F.coalesce(c(asset), F.lit("?")))
    dur, st, en, exact = _exact_window(c(minutes).cast("bigint"), c(start_s), c(end_s), title, year)
    cid = c(cid).cast("string")
    named = F.when(F.coalesce(cid, F.lit("")) == "", F.lit("n/a")).otherwise(cid)
    fallback = F.concat(a, F.lit("-"), dur.cast("string"), F.lit("m-cid"), named)
    return F.when(exact, _window_key(a, dur, st, en)).otherwise(fallback)


def round_fingerprint(asset: ColumnOrName, minutes: ColumnOrName, start_s: ColumnOrName, end_s: ColumnOrName,
                      title: ColumnOrName, year: int | ColumnOrName | None = None) -> Column:
    """Market-id-free round identity; falls back to the question."""
    a = F.upper(F.coalesce(c(asset), F.lit("?")))
    dur, st, en, exact = _exact_window(c(minutes).cast("bigint"), c(start_s), c(end_s), title, year)
    q = F.lower(F.trim(F.coalesce(c(title), F.lit(""))))
    fallback = F.concat(a, F.lit("-"), dur.cast("string"), F.lit("m-q:"), q)
    return F.when(exact, _window_key(a, dur, st, en)).otherwise(fallback)


def effective_end(end_s: ColumnOrName, start_s: ColumnOrName, minutes: ColumnOrName,
                  placed_s: ColumnOrName, mins_left: ColumnOrName) -> Column:
    """Best known end: stored, start + length, entry + minutes left, entry + length; else 0."""
    e, s, d, p, m = (F.coalesce(c(x).cast("double"), F.lit(0.0))
                     for x in (end_s, start_s, minutes, placed_s, mins_left))
    return (F.when(e > 0, e).when((s > 0) & (d > 0), s + d * 60.0)
            .when((p > 0) & (m > 0), p + m * 60.0)
            .when((p > 0) & (d > 0), p + d * 60.0).otherwise(F.lit(0.0)))


def repair_end(end_s: ColumnOrName, stored_end_s: ColumnOrName, now_s: ColumnOrName,
               minutes: ColumnOrName, exact: ColumnOrName) -> Column:
    """End of a position the venue reports open: date-only ends are false expiries."""
    e, st, now = c(end_s), c(stored_end_s), c(now_s)
    estimate = now + c(minutes) * 60.0
    expired = (e > 0) & (e <= now)
    date_only = (e % 86400.0 < 3600.0) & ~c(exact)
    return (F.when(F.coalesce(e, F.lit(0.0)) == 0.0, estimate)
            .when(expired & (F.coalesce(st, F.lit(0.0)) > now), st)
            .when(expired & date_only, estimate).otherwise(e))


def decision_price(tick: ColumnOrName, tick_age_ms: ColumnOrName, oracle: ColumnOrName,
                   oracle_age_s: ColumnOrName, tick_src: ColumnOrName | None = None, *,
                   oracle_fresh_s: float = 60.0, tick_max_age_ms: float = 1200.0) -> Column:
    """struct(price, src, quote_age_ms): fresh oracle, fresh tick, stale oracle, stale tick."""
    t, o = F.coalesce(c(tick), F.lit(0.0)), F.coalesce(c(oracle), F.lit(0.0))
    tag = F.coalesce(F.nullif(c(tick_src), F.lit("")), F.lit("RTDS")) if tick_src is not None else F.lit("RTDS")
    age = F.coalesce(c(tick_age_ms).cast("double"), F.lit(9e9))
    fresh_o = (o > 0) & F.coalesce(c(oracle_age_s) <= oracle_fresh_s, F.lit(False))
    fresh_t = (t > 0) & (age <= tick_max_age_ms)
    pick = lambda p, s, a: F.struct(p.alias("price"), s.alias("src"), a.alias("quote_age_ms"))
    return (F.when(fresh_o, pick(o, F.lit("CL"), F.lit(0.0)))
            .when(fresh_t, pick(t, tag, age))
            .when(o > 0, pick(o, F.lit("CL-stale"), age))
            .when(t > 0, pick(t, F.concat(tag, F.lit("-stale")), age)))


def current_price(tick: ColumnOrName, oracle: ColumnOrName) -> Column:
    """Tick when streaming, else the oracle."""
    return F.when(F.coalesce(c(tick), F.lit(0.0)) > 0, c(tick)).otherwise(F.coalesce(c(oracle), F.lit(0.0)))


def source_confidence(src: ColumnOrName) -> Column:
    return F.when(c(src) == "PM", F.lit(1.0)).when(c(src) == "CL-exact", F.lit(0.9)).otherwise(F.lit(0.6))


def source_score_adj(src: ColumnOrName, oracle_age_s: ColumnOrName, *, warn_s: float = 45.0,
                     warn_penalty: int = 2) -> Column:
    """Score change for the open-price source and the oracle's age."""
    s, age = c(src), c(oracle_age_s)
    by_src = F.when(s == "PM", F.lit(1)).when(s == "CL-exact", F.lit(0)).otherwise(F.lit(-1))
    by_age = F.when(age.isNull(), F.lit(-1)).when(age > warn_s, F.lit(-warn_penalty)).otherwise(F.lit(0))
    return by_src + by_age


def side_token_remap(token: ColumnOrName, opp_token: ColumnOrName, ask: ColumnOrName, opp_ask: ColumnOrName,
                     fair: ColumnOrName, *, min_error: float = 0.18, min_gain: float = 0.05) -> Column:
    """Opposite token when the kept ask is far off the fair price and the other is closer."""
    keep, swap = F.abs(c(ask) - c(fair)), F.abs(c(opp_ask) - c(fair))
    both = (F.coalesce(c(ask), F.lit(0.0)) > 0) & (F.coalesce(c(opp_ask), F.lit(0.0)) > 0)
    return F.when(both & (keep >= min_error) & (swap + min_gain < keep), c(opp_token)).otherwise(c(token))
