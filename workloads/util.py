"""Registration helper and SQL fragments shared by the twins."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """name -> (spark callable, DuckDB text or None)."""

    def add(self, name: str, twin: str | None = None) -> Callable:
        def deco(fn: Callable) -> Callable:
            if name in self:
                raise ValueError(name)
            self[name] = (fn, twin)
            return fn
        return deco


def cdf_sql(z: str) -> str:
    """Normal CDF by the 7.1.26 polynomial, as SQL."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0 + 0.3275911 * {x}))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592)"
    erf = f"(1.0 - {poly} * {t} * exp(-{x} * {x}))"
    return f"(0.5 * (1.0 + CASE WHEN {z} < 0 THEN -{erf} ELSE {erf} END))"


def clamp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


def wilson_sql(w: str, n: str) -> str:
    n_ = f"({n})::DOUBLE"
    ph = f"(({w}) / {n_})"
    return (f"CASE WHEN ({n}) > 0 THEN greatest(0.0, least(1.0, ({ph} + 1.0 / (2 * {n_}) - sqrt(({ph} * (1 - {ph}) + 1.0 / (4 * {n_})) "
            f"/ {n_})) / (1.0 + 1.0 / {n_}))) ELSE 0.5 END")


def pf_sql(gw: str, gl: str, no_loss: float = 2.0, neither: float = 1.0) -> str:
    return f"CASE WHEN {gl} > 0 THEN {gw} / {gl} WHEN {gw} > 0 THEN {no_loss} ELSE {neither} END"


def rnd(x: str, digits: int) -> str:
    """Half-up decimal rounding, the twin of ``round_to`` (DuckDB rounds doubles in binary)."""
    return f"round(({x})::DECIMAL(30, {digits + 5}), {digits})::DOUBLE"


LINE_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
