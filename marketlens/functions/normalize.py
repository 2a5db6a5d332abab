"""Row-level cleaning and classification of raw market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ColumnOrName, c, int_div

# Activity types that count as a purchase.
BUY_TYPES = ("TRADE", "BUY", "PURCHASE")
# Activity types that name a market side in the redeem history.
SIDE_TYPES = ("BUY", "TRADE", "PURCHASE", "SELL")
# Title keyword -> asset.
TITLE_ASSETS = (("bitcoin", "BTC"), ("ethereum", "ETH"), ("solana", "SOL"), ("xrp", "XRP"))
# Round series slug -> (asset, minutes).
SERIES_FAMILIES = (
    ("btc-up-or-down-15m", "BTC", 15),
    ("eth-up-or-down-15m", "ETH", 15),
    ("sol-up-or-down-15m", "SOL", 15),
    ("xrp-up-or-down-15m", "XRP", 15),
    ("btc-up-or-down-5m", "BTC", 5),
    ("eth-up-or-down-5m", "ETH", 5),
)
# Price-feed symbol -> asset.
SYMBOL_ASSETS = (("btcusdt", "BTC"), ("ethusdt", "ETH"), ("solusdt", "SOL"), ("xrpusdt", "XRP"))
# Order-id prefixes of bookkeeping rows, which never count in statistics.
BOOKKEEPING_PREFIXES = ("SYNC", "RECOVER", "ONCHAIN-REDEEM-QUEUE")


def norm_wallet(w: ColumnOrName) -> Column:
    return F.lower(F.trim(c(w)))


def norm_epoch(t: ColumnOrName) -> Column:
    """Seconds since epoch as a timestamp; values above 1e12 are milliseconds."""
    v = c(t).cast("double")
    secs = F.when(v > 1e12, v / 1000.0).otherwise(v)
    return F.timestamp_micros((secs * 1e6).cast("bigint"))


def classify_activity(typ: ColumnOrName, side: ColumnOrName, *, side_default_buy: bool) -> Column:
    """BUY / REDEEM / OTHER. A missing side counts as BUY only where asked."""
    t = F.upper(F.coalesce(c(typ), F.lit("")))
    s = F.upper(F.coalesce(c(side), F.lit("")))
    is_buy = s == "BUY"
    if side_default_buy:
        is_buy = is_buy | (s == "")
    return (F.when(t.isin(*BUY_TYPES) & is_buy, F.lit("BUY"))
            .when(t == "REDEEM", F.lit("REDEEM"))
            .otherwise(F.lit("OTHER")))


def outcome_side(outcome: ColumnOrName, side: ColumnOrName) -> Column:
    """Outcome when it names a market side, else the trade side, title-cased."""
    o = F.initcap(F.trim(F.coalesce(c(outcome), F.lit(""))))
    s = F.initcap(F.trim(F.coalesce(c(side), F.lit(""))))
    return F.when(o.isin("Up", "Down"), o).otherwise(s)


def parse_iso(text: ColumnOrName) -> Column:
    """Date and time to the second as a UTC timestamp; a zone offset behind it (or behind its fraction) counts, none means
    UTC. Unreadable text gives null."""
    t = F.trim(c(text))
    at = F.try_to_timestamp(F.replace(F.left(t, F.lit(19)), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = r"^.{19}(?:\.\d+)?\s*([+-])(\d{2}):?(\d{2})?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, zone, i).try_cast("int"), F.lit(0))
    shift = (part(2) * 60 + part(3)) * F.when(F.regexp_extract(t, zone, 1) == "-", 1).otherwise(-1)
    return at + F.make_dt_interval(mins=shift)


def winner_by_price(p0: ColumnOrName, p1: ColumnOrName, o0: ColumnOrName, o1: ColumnOrName,
                    threshold: float = 0.90) -> Column:
    """Outcome whose final price is above the threshold; null while undecided."""
    return F.when(c(p0) > threshold, c(o0)).when(c(p1) > threshold, c(o1))


def winner_by_argmax(p0: ColumnOrName, p1: ColumnOrName) -> Column:
    """Index of the dearer outcome; a tie goes to index 1."""
    return F.when(c(p0) > c(p1), F.lit(0)).otherwise(F.lit(1))


def winner_by_payout(denom: ColumnOrName, n0: ColumnOrName, n1: ColumnOrName) -> Column:
    """Side paid out on settlement; null when unsettled or ambiguous."""
    settled = c(denom) > 0
    return (F.when(settled & (c(n0) > 0) & (c(n1) == 0), F.lit("Up"))
            .when(settled & (c(n1) > 0) & (c(n0) == 0), F.lit("Down")))


def unpivot_sides(rounds: DataFrame, winner: str = "winner") -> DataFrame:
    """One row per (round, side) with ``won`` in {0, 1}."""
    return (rounds.withColumn("side", F.explode(F.array(F.lit("Up"), F.lit("Down"))))
            .withColumn("won", (F.col("side") == F.col(winner)).cast("bigint")))


def _keyword_asset(title: Column, otherwise: str = "?") -> Column:
    out = None
    for word, asset in TITLE_ASSETS:
        hit = title.contains(word)
        out = F.when(hit, F.lit(asset)) if out is None else out.when(hit, F.lit(asset))
    return out.otherwise(F.lit(otherwise))


def classify_family(series_slug: ColumnOrName, title: ColumnOrName) -> tuple[Column, Column]:
    """(asset, minutes) from the series slug, else from title keywords.

    The series list is six fixed rows, so it is written as a ``when`` chain instead of a join.
    """
    slug, q = c(series_slug), F.lower(F.coalesce(c(title), F.lit("")))
    asset = minutes = None
    for s, a, d in SERIES_FAMILIES:
        asset = F.when(slug == s, F.lit(a)) if asset is None else asset.when(slug == s, F.lit(a))
        minutes = F.when(slug == s, F.lit(d)) if minutes is None else minutes.when(slug == s, F.lit(d))
    # "15m" contains "5m": the longer text is tested first, unlike in the reference, which reads 15m titles as 5.
    by_title = F.when(q.contains("15m"), F.lit(15)).when(q.contains("5m"), F.lit(5)).otherwise(F.lit(0))
    return asset.otherwise(_keyword_asset(q)), minutes.otherwise(by_title)


def family_key(asset: ColumnOrName, minutes: ColumnOrName) -> Column:
    return F.concat(F.upper(c(asset)), F.lit("-"), c(minutes).cast("string"), F.lit("m"))


def slug_filter(slug: ColumnOrName, assets: tuple[str, ...] = ("BTC", "ETH")) -> Column:
    """5-minute round slugs of the given assets."""
    names = "|".join(sorted(a.strip().lower() for a in assets))
    return c(slug).rlike(f"^({names})-updown-5m-")


def symbol_asset(symbol: ColumnOrName) -> Column:
    """Asset of a feed symbol; null for symbols outside the fixed list."""
    s, out = F.lower(c(symbol)), None
    for sym, asset in SYMBOL_ASSETS:
        out = F.when(s == sym, F.lit(asset)) if out is None else out.when(s == sym, F.lit(asset))
    return out


def is_bookkeeping(order_id: ColumnOrName, historical_sync: ColumnOrName | None = None) -> Column:
    oid, out = F.upper(F.coalesce(c(order_id), F.lit(""))), F.lit(False)
    for p in BOOKKEEPING_PREFIXES:
        out = out | oid.startswith(p)
    if historical_sync is not None:
        out = out | F.coalesce(c(historical_sync), F.lit(False))
    return out


def age_bucket(age_s: ColumnOrName) -> Column:
    a = c(age_s)
    return (F.when(a.isNull(), F.lit("missing")).when(a <= 15, F.lit("0-15s"))
            .when(a <= 45, F.lit("15-45s")).when(a <= 90, F.lit("45-90s")).otherwise(F.lit("90s+")))


def score_bucket(score: ColumnOrName) -> Column:
    s = c(score)
    return (F.when(s.isNull(), F.lit("missing")).when(s < 6, F.lit("<6"))
            .when(s < 10, F.lit("6-9")).when(s < 14, F.lit("10-13")).otherwise(F.lit("14+")))


def bucket_key(minutes: ColumnOrName, score: ColumnOrName, entry: ColumnOrName) -> Column:
    """Statistics bucket, e.g. ``15m|s9-11|30-50c``."""
    s, e = c(score), c(entry)
    sb = F.when(s >= 12, F.lit("s12+")).when(s >= 9, F.lit("s9-11")).otherwise(F.lit("s0-8"))
    eb = F.when(e < 0.30, F.lit("<30c")).when(e <= 0.50, F.lit("30-50c")).otherwise(F.lit(">50c"))
    return F.concat_ws("|", F.concat(c(minutes).cast("string"), F.lit("m")), sb, eb)


def round_floor_us(t_us: ColumnOrName, minutes: int) -> Column:
    """Start of the 5- or 15-minute slot that holds an epoch-microsecond instant."""
    w = int(minutes) * 60_000_000
    return int_div(t_us, w) * F.lit(w)
