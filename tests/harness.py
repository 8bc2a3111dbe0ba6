"""Side-by-side check of a catalogue query against its DuckDB oracle (the driver's check, locally)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


DIGITS = int(__import__("os").environ.get("JF_CMP_DIGITS", "5"))


def _family(dtype) -> str:
    s = str(dtype).lower()
    if "bool" in s:
        return "bool"
    if "int" in s:
        return "int"
    if "float" in s or "double" in s or "decimal" in s:
        return "float"
    if "datetime" in s or "timestamp" in s:
        return "ts"
    return "other"


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), DIGITS) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if v is pd.NaT:
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    problems = []
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        problems.append(f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}")
        return problems
    for c in spark_pdf.columns:
        a, b = _family(spark_pdf[c].dtype), _family(oracle_pdf[c].dtype)
        if a != b and not (len(spark_pdf) == 0 or len(oracle_pdf) == 0):
            # pandas widens nullable ints to float; judge on values then
            if {a, b} != {"int", "float"} and "other" not in (a, b):
                problems.append(f"type of {c}: {spark_pdf[c].dtype} vs {oracle_pdf[c].dtype}")
    if len(spark_pdf) != len(oracle_pdf):
        problems.append(f"rows {len(spark_pdf)} vs {len(oracle_pdf)}")
        return problems
    ra, rb = _rows(spark_pdf), _rows(oracle_pdf)
    if ra != rb:
        diff = [(x, y) for x, y in zip(ra, rb) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems


def check(spark, key: str, sf_dir: str, con=None) -> list[str]:
    from journeyflow.plans.registry import all_oracles, all_queries

    q, o = all_queries(), all_oracles()
    con = con or duck(sf_dir)
    sp = q[key](spark, sf_dir).toPandas()
    if key not in o:
        return []
    od = con.execute(o[key]).df()
    return compare(sp, od)
