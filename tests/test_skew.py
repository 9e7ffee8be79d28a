"""A third of all rows on one key: results stay exact and shuffles carry partial aggregates."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from invlens.plans import capacity, directory, duplicates, ownership, size
from invlens.schema import SCAN_RESULTS, enforce_schema

N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(N):
        hot = i % 3 == 0  # a third of all rows share owner, folder and (filename, size)
        rows.append(
            (
                "r",
                f"win://h/S/f{i}",
                "/S/Shared/Hot/" if hot else f"/S/Shared/D{rnd.randint(0, 40)}/x/",
                "same.bin" if hot else f"f{rnd.randint(0, 500)}.bin",
                4 * 1048576 if hot else rnd.randint(0, 8 * 1048576),
                "DEMO\\GG_Hot" if hot else f"DEMO\\user{rnd.randint(0, 99)}",
            )
        )
    df = spark.createDataFrame(rows, "run_id string, file_uri string, file_path string, filename string, size long, owner_name string")
    return enforce_schema(df, SCAN_RESULTS).cache(), pd.DataFrame(rows, columns=["run_id", "file_uri", "file_path", "filename", "size", "owner_name"])


def test_results_exact_under_skew(skewed):
    inv, pdf = skewed
    pdf["dept"] = pdf.file_path.str.split("/").str[3]
    want = pdf.groupby("dept").agg(files=("size", "size"), bytes=("size", "sum")).reset_index()
    got = capacity.dept_breakdown(inv, "r").toPandas()[["dept", "files", "bytes"]]
    assert got.sort_values("dept").reset_index(drop=True).equals(want.sort_values("dept").reset_index(drop=True).astype(got.dtypes))
    top = ownership.top_owners(inv, "r", by="files", limit=1).first()
    assert (top["owner_name"], top["files"]) == ("DEMO\\GG_Hot", N // 3)
    d = duplicates.duplicate_clusters(inv, "r", limit=1).first()
    assert (d["filename"], d["copies"]) == ("same.bin", N // 3)
    q = size.size_quantiles(inv, "r").first()
    s = sorted(pdf["size"])
    assert q["p50_bytes"] == s[len(s) // 2]
    root = directory.directory_usage(inv, "r").where(F.col("directory") == "/S/Shared/Hot/").first()
    assert root["files"] == N // 3


def _partial_before_every_shuffle(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = "\n".join(lines[i + 1 : i + 4])
            if "partial_" not in below and "Sort" not in below:
                return False
    return True


@pytest.mark.parametrize(
    "build",
    [
        lambda inv: capacity.dept_breakdown(inv, "r"),
        lambda inv: ownership.top_owners(inv, "r", by="files"),
        lambda inv: duplicates.duplicate_clusters(inv, "r"),
        lambda inv: directory.directory_usage(inv, "r"),
        lambda inv: ownership.service_accounts(inv, "r", folders=True),
    ],
)
def test_shuffles_carry_partial_aggregates(skewed, build):
    inv, _ = skewed
    df = build(inv)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "partial_" in plan
    assert _partial_before_every_shuffle(plan), plan
