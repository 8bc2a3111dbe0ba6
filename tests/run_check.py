"""CLI: python tests/run_check.py /root/testdata/sf0.01 [key-prefix ...] -- Spark vs DuckDB per query."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck  # noqa: E402

from journeyflow.plans.registry import all_oracles, all_queries  # noqa: E402
from journeyflow.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_session()
    q, o = all_queries(), all_oracles()
    con = duck(sf)
    bad = 0
    for k in sorted(q):
        if prefixes and not any(k.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sp = q[k](spark, sf).toPandas()
            t1 = time.time()
            if k in o:
                od = con.execute(o[k]).df()
                probs = compare(sp, od)
                status = "OK " if not probs else "BAD"
            else:
                probs, status = [], "R  "
            if probs:
                bad += 1
            print(f"{status} {k:40s} rows={len(sp):7d} spark={t1 - t0:5.1f}s {'; '.join(probs)[:600]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {k:40s} {type(e).__name__}: {str(e)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
