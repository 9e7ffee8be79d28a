"""Run every registered report in Spark and its DuckDB SQL twin, and compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Prints one line per report (OK/FAIL, seconds, rows or the first
difference) and the number of failures; exit code 1 when any fails.
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from invlens import catalog  # noqa: E402
from invlens.session import build_session  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[*]", 8, app="invlens-oracle")
    con = duck(sf)
    queries, oracle = catalog.queries(), catalog.oracle()
    failures = 0
    for name, build in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            ok, msg = compare(build(spark, sf), con, oracle[name])
        except Exception as exc:  # report and go on
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:300]}"
        failures += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"failures {failures} of {len(only or queries)}")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
