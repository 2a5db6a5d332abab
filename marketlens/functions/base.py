"""Small Column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def c(x: ColumnOrName | int | float) -> Column:
    """Column from a name, a Python number, or a Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def safe_double(x: ColumnOrName, default: float | None = 0.0) -> Column:
    """Tolerant cast; text that is no number gives ``default``."""
    v = c(x).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def div_or(num: ColumnOrName, den: ColumnOrName, default: float | None) -> Column:
    """num / den, or ``default`` where den is 0 or null (never raises under ANSI)."""
    q = F.try_divide(c(num).cast("double"), c(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clamp(x: ColumnOrName, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c(x)))


def sum_if(cond: Column, value: ColumnOrName) -> Column:
    """Sum over matching rows; 0 where none match."""
    return F.coalesce(F.sum(F.when(cond, c(value))), F.lit(0.0))


def profit_factor(gross_win: ColumnOrName, gross_loss: ColumnOrName,
                  no_loss: float = 2.0, neither: float = 1.0) -> Column:
    """gross_win / gross_loss with the two fallbacks used when nothing was lost."""
    return (F.when(c(gross_loss) > 0, F.try_divide(c(gross_win), c(gross_loss)))
            .when(c(gross_win) > 0, F.lit(float(no_loss)))
            .otherwise(F.lit(float(neither))))


def first_reason(rules: Sequence[tuple[Column, str]], ok: str = "ok") -> Column:
    """Name of the first rule that holds, in the order given."""
    out = None
    for cond, reason in rules:
        hit = F.coalesce(cond, F.lit(False))
        out = F.when(hit, F.lit(reason)) if out is None else out.when(hit, F.lit(reason))
    return F.lit(ok) if out is None else out.otherwise(F.lit(ok))


def step(x: ColumnOrName, cuts: Iterable[tuple[float, object]], otherwise: object,
         op: str = "ge") -> Column:
    """First matching step of a threshold table: ``cuts`` are (limit, value)."""
    out = None
    x = c(x)
    test = {"ge": lambda v: x >= v, "gt": lambda v: x > v,
            "le": lambda v: x <= v, "lt": lambda v: x < v}[op]
    for limit, value in cuts:
        cond, val = test(limit), value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def epoch_us(ts: ColumnOrName) -> Column:
    """Epoch microseconds (bigint) of a timestamp or timestamp_ntz column, UTC session."""
    return F.unix_micros(c(ts).cast("timestamp"))


def epoch_s(ts: ColumnOrName) -> Column:
    return epoch_us(ts) / F.lit(1e6)


def int_div(a: ColumnOrName, b: int) -> Column:
    """Exact bigint division (a double quotient loses microseconds)."""
    return F.call_function("div", c(a), F.lit(int(b)).cast("bigint"))


def round_to(x: ColumnOrName, digits: int) -> Column:
    """Round a computed double, first dropping the noise that depends on summation order.

    Partitions are summed in no fixed order, so an exact half (0.59375 to 4 places) would round up
    in one run and down in the next.
    """
    return F.round(F.round(c(x), digits + 5), digits) + F.lit(0.0)  # no negative zero
