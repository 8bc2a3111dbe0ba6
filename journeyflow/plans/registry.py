"""Registry of catalogue entries.

``@query("k7_snapshot", sql=...)`` registers a Spark callable ``(spark, sf_dir) -> DataFrame``
and, when the operator has an exact SQL definition, the DuckDB oracle text.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "journeyflow.plans.q_clean",
    "journeyflow.plans.q_core",
    "journeyflow.plans.q_stats",
    "journeyflow.plans.q_features",
    "journeyflow.plans.q_sequences",
    "journeyflow.plans.q_sampling",
    "journeyflow.plans.q_scores",
    "journeyflow.plans.q_series",
    "journeyflow.plans.q_models",
    "journeyflow.plans.q_fits",
    "journeyflow.plans.q_project",
    "journeyflow.plans.q_stream",
    "journeyflow.plans.q_functions",
)


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise


ROUND_DIGITS = 9


def _float_columns() -> dict[str, list[str]]:
    import json
    import os

    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "float_columns.json")
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def _rounded(fn):
    """Round DOUBLE outputs to ROUND_DIGITS decimals: two engines summing in different orders
    differ in the last bits; 9 decimals removes that noise and keeps every real difference."""
    from functools import wraps

    @wraps(fn)
    def run(spark, sf_dir):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        df = fn(spark, sf_dir)
        kinds = (T.DoubleType, T.FloatType)
        scale = F.lit(float(10 ** ROUND_DIGITS))
        # round(x * 1e9) / 1e9: the same IEEE steps as the oracle's expression, so equal inputs
        # give equal outputs and last-ulp noise of sums disappears
        return df.select(*[(F.round(F.col(f"`{c.name}`").cast("double") * scale, 0) / scale).alias(c.name)
                           if isinstance(c.dataType, kinds) else F.col(f"`{c.name}`") for c in df.schema.fields])

    return run


def all_queries() -> dict[str, Callable]:
    _load()
    return {k: _rounded(fn) for k, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    """Oracle SQL with the query's DOUBLE columns cast to DOUBLE and rounded like the Spark side."""
    _load()
    fc = _float_columns()
    out = {}
    for k, sql in ORACLES.items():
        cols = fc.get(k)
        if cols:
            sc = f"{float(10 ** ROUND_DIGITS)}::DOUBLE"
            rep = ", ".join(f'round(CAST("{c}" AS DOUBLE) * {sc}) / {sc} AS "{c}"' for c in cols)
            sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS oracle_q"
        out[k] = sql
    return out
