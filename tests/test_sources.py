"""Readers, writers, probe text formats, export batch."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS
from invlens.sources.export import export_reports
from invlens.sources.fixture import fixture_inventory
from invlens.sources.inventory import list_runs, read_inventory, read_physical, read_report_csv, text_rejects, write_inventory
from invlens.sources.probes import (
    append_physical,
    drop_run,
    load_probe_results,
    load_probe_tsv,
    probe_feed,
    probe_result_rejects,
    split_rejects,
    write_probe_feed,
)

from conftest import SF_SMALL


def test_write_read_partition_pruning(spark, scratch):
    path = os.path.join(scratch, "inv")
    write_inventory(fixture_inventory(spark, SF_SMALL), path, mode="overwrite", num_files=4)
    df = read_inventory(spark, path, run_id="run-1")
    assert df.schema == SCAN_RESULTS
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run-1" in plan
    assert df.count() == fixture_inventory(spark, SF_SMALL).where(F.col("run_id") == "run-1").count()
    assert [r["run_id"] for r in list_runs(read_inventory(spark, path)).collect()] == ["run-2", "run-1"]


def test_probe_feed_roundtrip(spark, scratch):
    inv = fixture_inventory(spark, SF_SMALL)
    feed_dir = os.path.join(scratch, "feed")
    write_probe_feed(probe_feed(inv, "run-2"), feed_dir)
    back = load_probe_tsv(spark, feed_dir)
    assert back.count() == inv.where((F.col("run_id") == "run-2") & (F.col("filename") != "")).count()


def test_probe_text_parsing(spark, scratch):
    src = os.path.join(scratch, "probes.txt")
    with open(src, "w") as fh:
        fh.write("r\twin://h/S/a\t4096\n\nno tab here\nr\twin://h/S/b\tnotanumber\nr\twin://h/S/c\t0\n")
    feed = load_probe_tsv(spark, src)
    assert feed.count() == 3  # the two odd lines are skipped, bad number kept as a feed line
    res = load_probe_results(spark, src, probed_at=dt.datetime(2024, 6, 1, 12))
    got = sorted((r["file_uri"], r["allocated"]) for r in res.collect())
    assert got == [("win://h/S/a", 4096), ("win://h/S/c", 0)]
    bad = sorted(map(tuple, probe_result_rejects(spark.read.text(src)).collect()))
    assert bad == [("BAD_NUMBER", "r\twin://h/S/b\tnotanumber"), ("NO_TAB", "no tab here")]


def test_append_and_drop_run(spark, scratch):
    path = os.path.join(scratch, "phys")
    rows = spark.createDataFrame([("r1", "u", 1), ("r2", "v", 2)], "run_id string, file_uri string, allocated long")
    append_physical(rows, path, probed_at=dt.datetime(2024, 6, 1, 12))
    append_physical(rows, path, probed_at="2024-06-01 13:00:00")
    df = read_physical(spark, path)
    assert df.schema == FILE_PHYSICAL and df.count() == 4
    drop_run(spark, "r1", path=path)
    with pytest.raises(ValueError):
        drop_run(spark, "r1", path=path)
    assert [r[0] for r in read_physical(spark, path).select("run_id").distinct().collect()] == ["r2"]


def test_split_rejects(spark):
    feed = spark.createDataFrame([("r", "win://h/S/a%20b"), ("r", "win://h/Shared/x"), ("r", "nfs://x")], "run_id string, file_uri string")
    good, bad = split_rejects(feed)
    assert [r["win_path"] for r in good.collect()] == ["S:\\a b"]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["PATH_CONVERT", "PATH_CONVERT"]


def test_export_batch_keeps_going(spark, scratch):
    out = os.path.join(scratch, "export")
    inv = fixture_inventory(spark, SF_SMALL)

    def broken():
        raise RuntimeError("boom")

    status = {r["report"]: r for r in export_reports(spark, {
        "files": inv.groupBy("run_id").count(),
        "broken": broken,
    }, out).collect()}
    assert status["files"]["ok"] and not status["broken"]["ok"] and "boom" in status["broken"]["error"]
    back = read_report_csv(spark, os.path.join(out, "files"))
    assert back.count() == 2


def test_csv_source_is_read_as_text(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="invlens-csv-"), "inv.csv")
    times = {
        "a": ("2024-01-02 03:04:05.123", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
        "b": ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        "c": ("2024-01-02", dt.datetime(2024, 1, 2)),
        "d": ("02/01/2024 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        "e": ("2024-01-02T03:04:05.123456789Z", dt.datetime(2024, 1, 2, 3, 4, 5, 123456)),
        "f": ("2024-01-02 03:04:05+0200", dt.datetime(2024, 1, 2, 1, 4, 5)),
        "g": ("1704164645", dt.datetime(2024, 1, 2, 3, 4, 5)),
        "h": ("", None),
    }
    with open(path, "w") as fh:
        fh.write("run_id,file_uri,size,modified,owner_name,filename,migrated\n")
        for k, (text, _) in times.items():
            fh.write(f"r,win://h/S/{k},10,{text},,,true\n")
    df = read_inventory(spark, path, format="csv")
    assert df.schema == SCAN_RESULTS
    rows = {r["file_uri"][-1]: r for r in df.collect()}
    assert {k: rows[k]["modified"] for k in times} == {k: v for k, (_, v) in times.items()}
    assert all(r["owner_name"] == "" and r["filename"] == "" and r["size"] == 10 and r["migrated"] for r in rows.values())
    with open(path, "a") as fh:
        fh.write("r,win://h/S/x,many,yesterday,o,n,true\n")
    with pytest.raises(Exception, match="unreadable"):
        read_inventory(spark, path, format="csv").collect()
    assert read_inventory(spark, path, format="csv", bad="skip").count() == len(times)
    kept = [r for r in read_inventory(spark, path, format="csv", bad="null").collect() if r["file_uri"].endswith("x")]
    assert kept[0]["size"] is None and kept[0]["modified"] is None
    bad = text_rejects(spark, path, SCAN_RESULTS).collect()
    assert len(bad) == 1 and bad[0]["reason"] == "size,modified" and "yesterday" in bad[0]["original"]


def test_runs_with_special_ids(spark):
    path = tempfile.mkdtemp(prefix="invlens-runs-") + "/phys"
    rows = spark.createDataFrame([("a:1", "u", 1), ("o'b", "v", 2)], "run_id string, file_uri string, allocated long")
    append_physical(rows, path, probed_at="2024-06-01 13:00:00")
    drop_run(spark, "a:1", path=path)
    assert [r[0] for r in read_physical(spark, path).select("run_id").collect()] == ["o'b"]


def test_compaction_keeps_other_runs(spark):
    from invlens.sources.probes import compact_physical

    base = tempfile.mkdtemp(prefix="invlens-compact-")
    rows = spark.createDataFrame([("a", "u", 1), ("b", "v", 2)], "run_id string, file_uri string, allocated long")
    append_physical(rows, f"{base}/all", probed_at="2024-06-01 13:00:00")
    for run in ("a", "b", "a"):
        compact_physical(read_physical(spark, f"{base}/all"), f"{base}/small", run_id=run)
    assert sorted(r[0] for r in read_physical(spark, f"{base}/small").select("run_id").collect()) == ["a", "b"]


def test_bucketed_table_grows_by_runs(spark):
    from invlens.sources.inventory import register_bucketed, write_bucketed

    path, table = tempfile.mkdtemp(prefix="invlens-bucket-"), f"inv_grow_{os.getpid()}"
    inv = fixture_inventory(spark, SF_SMALL)
    for run in ("run-1", "run-2", "run-1"):
        write_bucketed(inv.where(F.col("run_id") == run), table, path, 4)
    got = {r["run_id"]: r["count"] for r in spark.table(table).groupBy("run_id").count().collect()}
    assert got == {r["run_id"]: r["count"] for r in inv.groupBy("run_id").count().collect()}
    assert spark.table(table).select(*inv.columns).exceptAll(inv).count() == 0
    with pytest.raises(ValueError):
        register_bucketed(spark, table, path + "-other", 4)
    spark.sql(f"DROP TABLE {table}")


def test_compact_physical_same_reports(spark, scratch):
    from invlens.plans import physical
    from invlens.sources.fixture import file_physical_from_inventory
    from invlens.sources.probes import compact_physical

    inv = fixture_inventory(spark, SF_SMALL)
    phys = file_physical_from_inventory(inv)
    out = os.path.join(scratch, "compacted")
    compact_physical(phys, out)
    small = read_physical(spark, out)
    assert small.count() == phys.select("run_id", "file_uri").distinct().count()
    a = physical.logical_physical_tiles(inv, phys, "run-2").collect()
    b = physical.logical_physical_tiles(inv, small, "run-2").collect()
    assert a == b


def test_standard_export(spark, scratch):
    from invlens.plans.export_batch import export_standard, standard_reports
    from invlens.sources.fixture import AS_OF

    inv = fixture_inventory(spark, SF_SMALL)
    out = os.path.join(scratch, "standard")
    status = export_standard(spark, inv, "run-2", AS_OF, out).collect()
    assert len(status) == len(standard_reports(inv, AS_OF)) == 20
    assert all(r["ok"] for r in status), [r["error"] for r in status if not r["ok"]]
    ov = read_report_csv(spark, os.path.join(out, "overview")).first()
    assert ov["files"] == inv.where(F.col("run_id") == "run-2").count()


def test_kpis_match_tiles(spark):
    from invlens.plans import cost, overview
    from invlens.sources.fixture import AS_OF

    inv = fixture_inventory(spark, SF_SMALL)
    k = overview.kpis(inv, "run-2", AS_OF).first()
    assert k["files"] == overview.total_files(inv, "run-2").first()["files"]
    assert k["oldest"] == overview.oldest_modified(inv, "run-2").first()["oldest"]
    assert k["pct_orphan"] == overview.pct_orphan_files(inv, "run-2").first()["pct"]
    assert k["usd_mo"] == cost.hot_cost(inv, "run-2").first()["usd_mo"]
    assert k["savings"] == cost.archive_savings(inv, "run-2", AS_OF).first()["savings"]


def test_write_with_rejects(spark, scratch):
    from invlens.sources.probes import write_with_rejects

    feed = spark.createDataFrame([("r", "win://h/S/a"), ("r", "nfs://x"), ("r", "win://h/T/b")], "run_id string, file_uri string")
    out = os.path.join(scratch, "rejects")
    write_with_rejects(feed, out)
    back = spark.read.parquet(out)
    counts = {r["outcome"]: r["count"] for r in back.groupBy("outcome").count().collect()}
    assert counts == {"OK": 2, "PATH_CONVERT": 1}


def test_json_source_roundtrip(spark, scratch):
    inv = fixture_inventory(spark, SF_SMALL).where(F.col("run_id") == "run-1")
    path = os.path.join(scratch, "inv_json")
    text_times = inv.select(
        *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in ("created", "modified", "last_accessed") else F.col(c)
          for c in inv.columns]
    )
    text_times.write.mode("overwrite").json(path)
    back = read_inventory(spark, path, run_id="run-1", format="json")
    assert back.schema == SCAN_RESULTS
    cols = ["file_uri", "size", "owner_name", "created", "modified", "last_accessed"]
    assert sorted(back.select(*cols).collect()) == sorted(inv.select(*cols).collect())
