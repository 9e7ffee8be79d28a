"""Print the formatted physical plans of the headline reports.

Usage: python tools/show_plans.py [data_dir] [report ...]
``data_dir`` holds ``scan_results`` and ``file_physical`` Parquet tables
(for example the benchmark's data folder). Plans are printed after one
run so the AQE final plan is shown.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from invlens.plans import capacity, directory, duplicates, overview, physical, size  # noqa: E402
from invlens.session import build_session  # noqa: E402
from invlens.sources.fixture import AS_OF, DEFAULT_RUN  # noqa: E402
from invlens.sources.inventory import read_inventory, read_physical  # noqa: E402


def main() -> None:
    data = sys.argv[1] if len(sys.argv) > 1 else "/tmp/invlens-bench-data/sf0.1-r2x66-f32-b32"
    wanted = set(sys.argv[2:])
    spark = build_session("local[8]", 16)
    inv = read_inventory(spark, f"{data}/scan_results")
    phys = read_physical(spark, f"{data}/file_physical")
    run = DEFAULT_RUN
    reports = {
        "overview": lambda: overview.overview(inv, run, AS_OF),
        "dept_breakdown_pct": lambda: capacity.dept_breakdown(inv, run, pct=True),
        "cold_folders": lambda: capacity.cold_folders(inv, run, AS_OF),
        "size_quantiles": lambda: size.size_quantiles(inv, run),
        "duplicate_clusters": lambda: duplicates.duplicate_clusters(inv, run),
        "directory_usage": lambda: directory.directory_usage(inv, run),
        "logical_physical_tiles": lambda: physical.logical_physical_tiles(inv, phys, run),
        "missing_files": lambda: physical.missing_files(inv, phys, run).agg(F.count(F.lit(1)).alias("n")),
    }
    for name, build in reports.items():
        if wanted and name not in wanted:
            continue
        df = build()
        df.collect()
        print(f"===== {name}")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
