"""Regenerate journeyflow/plans/float_columns.json: the DOUBLE output columns of every query.

The catalogue rounds these to 9 decimals on both engines (removes last-ulp noise of sums) and
casts the oracle's columns to DOUBLE (DuckDB types decimal literals as DECIMAL)."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from journeyflow.plans.registry import QUERIES, _load  # noqa: E402
from journeyflow.session import get_session  # noqa: E402


def main():
    spark = get_session("local[4]")
    _load()
    out = {}
    for k, fn in sorted(QUERIES.items()):
        schema = fn(spark, "/root/testdata/sf0.001").schema
        cols = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        if cols:
            out[k] = cols
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "journeyflow", "plans", "float_columns.json")
    with open(path, "w") as f:
        json.dump(out, f, indent=1, sort_keys=True)
    print(len(out), "queries with double columns")


if __name__ == "__main__":
    main()
