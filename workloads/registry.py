"""Collects the queries of every workload module."""

from __future__ import annotations

from . import asof_q, features_q, market_q, perf_q, scalar_q, scoring_q, wallets_q

QUERIES: dict = {}
TWINS: dict[str, str] = {}
for _m in (scalar_q, wallets_q, asof_q, features_q, perf_q, market_q, scoring_q):
    for _name, (_fn, _sql) in _m.REGISTERED.items():
        if _name in QUERIES:
            raise ValueError(f"query {_name} registered twice")
        QUERIES[_name] = _fn
        if _sql is not None:
            TWINS[_name] = _sql
