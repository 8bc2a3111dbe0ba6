"""Print a markdown summary of the physical plans of the headline queries (shuffle keys,
broadcasts, windows, scans with pushed filters). Used to write PLANS.md."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402

from journeyflow.plans.registry import all_queries  # noqa: E402
from journeyflow.session import get_session  # noqa: E402


def main():
    spark = get_session("local[8]", partitions=16)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q = all_queries()
    print("| query | shuffles (hash keys) | broadcasts | windows (partition keys) | parquet scans |")
    print("|---|---|---|---|---|")
    for name in HEADLINE:
        plan = q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
        keys = sorted({re.sub(r"#\d+L?", "", k) for k in shuffles})
        bcast = plan.count("BroadcastExchange")
        wins = sorted({re.sub(r"#\d+L?", "", w) for w in re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)})
        scans = plan.count("FileScan parquet")
        print(f"| {name} | {len(shuffles)}: {'; '.join(keys)} | {bcast} | {'; '.join(wins)} | {scans} |")


if __name__ == "__main__":
    main()
