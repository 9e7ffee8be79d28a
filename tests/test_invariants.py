"""Partition-of-total invariants and the fixture's published check values (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from invlens.functions import has_flag, is_directory, large_and_stale, newer_than, stale
from invlens.plans import acl, age, capacity, duplicates, overview, ownership, physical, size
from invlens.sources.fixture import AS_OF, fixture_tables

RUN = "run-2"


@pytest.fixture(scope="module")
def tables(spark):
    inv, phys = fixture_tables(spark, SF_ORACLE)
    return inv.cache(), phys.cache()


def totals(df, files="files", bytes_="bytes"):
    r = df.agg(F.sum(files).alias("f"), F.sum(bytes_).alias("b")).first()
    return r["f"], r["b"]


def test_fixture_check_values(tables):
    inv, phys = tables
    runs = {r["run_id"]: (r["n"], r["b"]) for r in inv.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert runs == {"run-1": (13500, 6296397445840), "run-2": (15000, 6987417991977)}
    r2 = inv.where(F.col("run_id") == RUN)
    r = r2.agg(
        F.count_if(is_directory()).alias("dirs"),
        F.count_distinct("owner_sid").alias("sids"),
        F.count_if(stale("last_accessed", 3, AS_OF)).alias("dormant"),
        F.count_if(newer_than("modified", 1, AS_OF)).alias("recent"),
        F.count_if(has_flag("B")).alias("b"),
        F.count_if(has_flag("P")).alias("p_any"),
        F.count_if(has_flag("P", True)).alias("p_upper"),
        F.count_if(F.year("created") == 2019).alias("y2019"),
        F.min(F.year("created")).alias("ymin"),
        F.max(F.year("created")).alias("ymax"),
        F.count_if(large_and_stale(as_of=AS_OF)).alias("ls"),
    ).first()
    assert r.asDict() == {
        "dirs": 16, "sids": 40, "dormant": 6062, "recent": 277, "b": 9000, "p_any": 3000, "p_upper": 1500,
        "y2019": 2220, "ymin": 2016, "ymax": 2022, "ls": 500,
    }
    assert overview.orphan_count(inv, RUN).first()["orphans"] == 1533
    p2 = phys.where(F.col("run_id") == RUN)
    assert p2.count() == 15371 and p2.select("file_uri").distinct().count() == 14281
    assert physical.missing_files(inv, phys, RUN).count() == 703
    assert physical.physical_total(phys, RUN).first()["physical_bytes"] == 1545401219
    d = duplicates.duplicate_floor(inv, RUN).first()
    assert (d["dup_clusters"], d["total_wasted_bytes"]) == (1500, 105656618863)


def test_partitions_of_total(tables):
    inv, _ = tables
    want = totals(inv.where(F.col("run_id") == RUN).select(F.lit(1).alias("files"), F.col("size").alias("bytes")))
    for rep in (
        ownership.ownership_split(inv, RUN),
        ownership.chargeback(inv, RUN),
        ownership.chargeback(inv, RUN, mode="orphan_svc_admin_all"),
        size.size_buckets(inv, RUN),
        size.size_bands(inv, RUN),
        age.age_bands(inv, RUN, AS_OF),
        acl.acl_pattern_classifier(inv, RUN),
        capacity.year_histogram(inv, RUN, lo=1900, hi=2100),
    ):
        assert totals(rep) == want
    assert totals(acl.acl_flag_distribution(inv, RUN, limit=1000), bytes_="files")[0] == want[0]
    shares = age.age_bands(inv, RUN, AS_OF).agg(F.sum("pct_files"), F.sum("pct_bytes")).first()
    assert abs(shares[0] - 100) < 0.05 and abs(shares[1] - 100) < 0.05


def test_service_accounts_equal_ownership_bucket(tables):
    inv, _ = tables
    svc = totals(ownership.service_accounts(inv, RUN))
    bucket = ownership.ownership_split(inv, RUN).where(F.col("bucket") == "ServiceAccount").first()
    assert svc == (bucket["files"], bucket["bytes"])


def test_duplicate_reclaimable(tables):
    inv, _ = tables
    d = duplicates.duplicate_floor(inv, RUN).first()
    assert d["reclaimable_file_count"] == d["total_duplicate_files"] - d["dup_clusters"]


def test_directory_usage_root_is_total(tables):
    from invlens.plans.directory import directory_usage

    inv, _ = tables
    root = directory_usage(inv, RUN).where(F.col("directory") == "/").first()
    r2 = inv.where(F.col("run_id") == RUN).agg(F.count_if(F.col("filename") != "").alias("f"), F.sum("size").alias("b")).first()
    assert (root["files"], root["bytes"]) == (r2["f"], r2["b"])


def test_reconcile_and_compare_runs(tables):
    from invlens.plans.runs import compare_dept_runs, reconcile_runs

    inv, _ = tables
    rec = {r["metric"]: r for r in reconcile_runs(inv, "run-1", "run-2", AS_OF, tolerance=0.2).collect()}
    assert rec["files"]["value"] == 15000 and rec["files"]["expected"] == 13500 and rec["files"]["within"]
    cmp = compare_dept_runs(inv, "run-1", "run-2").agg(F.sum("files_delta")).first()[0]
    d2 = capacity.dept_breakdown(inv, "run-2").agg(F.sum("files")).first()[0]
    d1 = capacity.dept_breakdown(inv, "run-1").agg(F.sum("files")).first()[0]
    assert cmp == d2 - d1


def test_directories_count_as_files_unless_filtered(tables):
    """Directory rows (size 0) land in '<1K' by default; is_file() removes them."""
    from invlens.functions import is_file

    inv, _ = tables
    run = inv.where(F.col("run_id") == RUN)
    dirs = run.where(is_directory()).count()
    with_dirs = {r["bucket"]: r["files"] for r in size.size_buckets(inv, RUN).collect()}
    files_only = {r["bucket"]: r["files"] for r in size.size_buckets(inv.where(is_file()), RUN).collect()}
    assert dirs == 16
    assert with_dirs["<1K"] - files_only["<1K"] == dirs
    assert sum(with_dirs.values()) == run.count()
