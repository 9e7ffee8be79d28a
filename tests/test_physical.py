"""Latest-probe semantics, joins and physical reports on literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from invlens.operators import latest_physical, missing_probes, orphan_probes, with_physical
from invlens.plans import physical
from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS, enforce_schema

T0, T1 = dt.datetime(2024, 6, 1, 12), dt.datetime(2024, 6, 1, 13)


def inv_df(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, file_uri string, filename string, size long")
    return enforce_schema(df, SCAN_RESULTS)


def phys_df(spark, rows):
    return spark.createDataFrame(rows, FILE_PHYSICAL)


@pytest.fixture()
def tables(spark):
    inv = inv_df(spark, [
        ("r", "u1", "a", 100), ("r", "u2", "b", 200), ("r", "u3", "c", 300), ("r", "d/", "", 0), ("q", "u1", "a", 5),
    ])
    phys = phys_df(spark, [
        ("r", "u1", 4096, T0), ("r", "u1", 8192, T1),  # re-probe: later wins
        ("r", "u2", 10, T0), ("r", "u2", 20, T0),  # tie on time: larger wins
        ("r", "zz", 7, T0),  # probe with no inventory row
    ])
    return inv, phys


def test_latest_wins_and_tie(tables):
    _, phys = tables
    got = {r["file_uri"]: r["allocated"] for r in latest_physical(phys).collect()}
    assert got == {"u1": 8192, "u2": 20, "zz": 7}


@pytest.mark.parametrize("mode,want", [("null", None), ("zero", 0), ("logical", 300)])
def test_with_physical_on_missing(tables, mode, want):
    inv, phys = tables
    rows = {r["file_uri"]: r for r in with_physical(inv, phys, "r", on_missing=mode).collect()}
    assert rows["u1"]["allocated"] == 8192 and rows["u1"]["probed"]
    assert rows["u3"]["allocated"] == want and not rows["u3"]["probed"]
    assert len(rows) == 4  # each inventory row exactly once


def test_with_physical_broadcast_is_left_to_aqe(tables):
    inv, phys = tables
    joined = with_physical(inv, phys, "r")
    planned = joined._jdf.queryExecution().executedPlan().toString()
    assert "AdaptiveSparkPlan" in planned and "BroadcastHashJoin" not in planned
    assert joined.count() == 4


def test_hot_probe_is_reduced_before_the_shuffle(spark, tables):
    inv, phys = tables
    hot = phys.union(spark.range(5000).select(F.lit("r"), F.lit("u1"), F.col("id"), F.lit(T0).cast("timestamp_ntz")))
    out = missing_probes(inv, hot, "r")
    plan = out._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("LeftAnti"):]
    assert "HashAggregate" in anti
    assert [r[0] for r in out.collect()] == ["u3"]


def test_compare_pairs_null_keys(spark):
    from invlens.operators.compare import compare_reports

    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, files long")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, files long")
    got = sorted((str(r["k"]), r["files_before"], r["files_after"], r["files_delta"]) for r in compare_reports(a, b, ["k"], ["files"]).collect())
    assert got == [("None", 1, 3, 2), ("x", 2, None, -2), ("y", None, 4, 4)]


def test_missing_and_orphans(tables):
    inv, phys = tables
    assert [r[0] for r in missing_probes(inv, phys, "r").collect()] == ["u3"]
    assert [tuple(r) for r in orphan_probes(inv, phys, "r").collect()] == [("r", "zz")]


def test_tiles_join_vs_sums(tables):
    inv, phys = tables
    j = physical.logical_physical_tiles(inv, phys, "r").first()
    assert (j["logical_bytes"], j["on_disk_bytes"], j["probed_files"], j["files"]) == (600, 8212, 2, 3)
    s = physical.logical_physical_tiles(inv, phys, "r", method="sums").first()
    assert s["on_disk_bytes"] == 8219  # counts the orphan probe: only equal when there is none


def test_coverage_ratio_histogram(tables):
    inv, phys = tables
    c = physical.coverage(inv, phys, "r").first()
    assert (c["expected"], c["probed"], c["missing"]) == (3, 3, 0)
    r = physical.physical_ratio(inv, phys, "r").first()
    assert r["physical_over_logical"] == round(8219 / 600, 4)
    h = {x["allocated"]: x["files"] for x in physical.allocation_histogram(phys, "r").collect()}
    assert h == {7: 1, 20: 1, 8192: 1}
    raw = physical.physical_total(phys, "r", dedupe=False).first()["physical_bytes"]
    assert raw == 4096 + 8192 + 10 + 20 + 7


def test_empty_physical(spark, tables):
    inv, _ = tables
    empty = phys_df(spark, [])
    j = physical.logical_physical_tiles(inv, empty, "r").first()
    assert (j["on_disk_bytes"], j["probed_files"], j["on_disk_capacity"]) == (0, 0, "0.00 B")
    p = physical.probe_progress(empty, "r").first()
    assert p["probed"] == 0 and p["started"] is None


def test_capacity_toggle(tables):
    inv, phys = tables
    assert physical.capacity_tile(inv, phys, "r", "Logical").first()["capacity_bytes"] == 600
    assert physical.capacity_tile(inv, phys, "r", "Physical").first()["capacity_bytes"] == 8212
    with pytest.raises(ValueError):
        physical.capacity_tile(inv, phys, "r", "Other")


def test_content_duplicates(spark):
    from invlens.plans.duplicates import content_duplicates

    df = spark.createDataFrame(
        [("r", "h1", 10), ("r", "h1", 10), ("r", "h1", 10), ("r", "h2", 5), ("r", "h3", 7), ("r", "h3", 7), ("q", "h2", 5)],
        "run_id string, hash string, size long",
    )
    got = {(r["hash"], r["copies"], r["wasted_bytes"]) for r in content_duplicates(df, "r").collect()}
    assert got == {("h1", 3, 20), ("h3", 2, 7)}
    with pytest.raises(ValueError):
        content_duplicates(df.drop("hash"), "r")


def test_sums_without_dedupe_on_compacted(spark, tables):
    inv, phys = tables
    compacted = latest_physical(phys).select("run_id", "file_uri", "allocated", "probed_at")
    a = physical.logical_physical_tiles(inv, compacted, "r", method="sums", dedupe=False).first()
    b = physical.logical_physical_tiles(inv, phys, "r", method="sums").first()
    assert a == b
