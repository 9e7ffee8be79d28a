"""Streaming monitors driven to completion with availableNow triggers."""

import os
import tempfile

from pyspark.sql import functions as F

from invlens.plans.runs import inventory_snapshot
from invlens.sources.fixture import fixture_inventory
from invlens.sources.inventory import read_physical, write_inventory
from invlens.sources.probes import append_physical, drop_run
from invlens.streaming import (
    inventory_stream,
    inventory_totals,
    load_probe_stream,
    monitor_inventory,
    monitor_probes,
    probe_completion,
    start_monitor,
)

from conftest import SF_SMALL


def test_inventory_monitor_matches_batch(spark, scratch):
    path = os.path.join(scratch, "stream_inv")
    inv = fixture_inventory(spark, SF_SMALL)
    write_inventory(inv, path, mode="overwrite", num_files=3)
    ckpt = tempfile.mkdtemp(prefix="ck-", dir=scratch)
    q = start_monitor(monitor_inventory(inventory_stream(spark, path)), "inv_mon", ckpt, available_now=True)
    q.awaitTermination(120)
    got = inventory_totals(spark.table("inv_mon")).first()
    want = inventory_snapshot(inv).first()
    assert got.asDict() == want.asDict()


def test_probe_load_and_progress(spark, scratch):
    src = tempfile.mkdtemp(prefix="probes-src-", dir=scratch)
    dst = os.path.join(scratch, "probes-dst")
    with open(os.path.join(src, "b1.tsv"), "w") as fh:
        fh.write("run-2\twin://h/S/a\t4096\nrun-2\twin://h/S/b\t131072\n\nbad line\n")
    ckpt = tempfile.mkdtemp(prefix="ck-", dir=scratch)
    load_probe_stream(spark, src, dst, ckpt).awaitTermination(120)
    with open(os.path.join(src, "b2.tsv"), "w") as fh:
        fh.write("run-1\twin://h/S/c\t0\nrun-2\twin://h/S/a\t8192\n")
    load_probe_stream(spark, src, dst, ckpt).awaitTermination(120)  # restart: only the new file
    phys = read_physical(spark, dst)
    assert phys.count() == 4
    ckpt2 = tempfile.mkdtemp(prefix="ck-", dir=scratch)
    stream = spark.readStream.schema(phys.schema).parquet(dst)
    q = start_monitor(monitor_probes(stream), "probe_mon", ckpt2, available_now=True)
    q.awaitTermination(120)
    rows = {r["run_id"]: r for r in spark.sql("SELECT * FROM probe_mon").collect()}
    assert rows["run-2"]["probed"] == 3 and rows["run-1"]["probed"] == 1
    done = {r["run_id"]: r for r in probe_completion(phys, {"run-2": 3, "run-1": 1}).collect()}
    assert done["run-2"]["files_probed"] == 2 and not done["run-2"]["done"] and done["run-1"]["done"]
    bad = spark.read.parquet(dst + "_rejects").collect()
    assert [(r["reject_reason"], r["original"]) for r in bad] == [("NO_TAB", "bad line")]
    assert phys.where(F.col("probed_at").isNull()).count() == 0


def test_streamed_and_appended_rows_share_a_table(spark):
    base = tempfile.mkdtemp(prefix="invlens-shared-")
    os.mkdir(f"{base}/src")
    with open(f"{base}/src/b1.tsv", "w") as fh:
        fh.write("r1\tu1\t1\nr1\tu2\t2\nr2\tu3\t3\n")
    batch = spark.createDataFrame([("r1", "u9", 9), ("r3", "u8", 8)], "run_id string, file_uri string, allocated long")
    append_physical(batch, f"{base}/dst")
    load_probe_stream(spark, f"{base}/src", f"{base}/dst", f"{base}/ck").awaitTermination(120)
    assert read_physical(spark, f"{base}/dst").count() == 5
    append_physical(batch, f"{base}/dst")
    assert read_physical(spark, f"{base}/dst").count() == 7
    drop_run(spark, "r2", path=f"{base}/dst")
    assert sorted(r[0] for r in read_physical(spark, f"{base}/dst").select("run_id").distinct().collect()) == ["r1", "r3"]


def test_repeated_load_replaces_its_own_files(spark):
    from invlens.sources.probes import with_probed_at
    from invlens.streaming.monitor import _land

    base = tempfile.mkdtemp(prefix="invlens-again-")
    rows = with_probed_at(spark.createDataFrame([("r1", "u", 1), ("r2", "v", 2)], "run_id string, file_uri string, allocated long"))
    for load in ("x-0", "x-0", "x-1"):
        rows.write.mode("overwrite").partitionBy("run_id").parquet(f"{base}/dst/_loads/{load}")
        _land(spark, f"{base}/dst/_loads/{load}", f"{base}/dst", load)
    assert read_physical(spark, f"{base}/dst").count() == 4


def test_two_loads_without_checkpoint_run_side_by_side(spark):
    base = tempfile.mkdtemp(prefix="invlens-two-")
    for k in ("a", "b"):
        os.makedirs(f"{base}/{k}")
        with open(f"{base}/{k}/x.tsv", "w") as fh:
            fh.write(f"r\t{k}\t1\n")
    for k in ("a", "b"):
        load_probe_stream(spark, f"{base}/{k}", f"{base}/dst").awaitTermination(120)
    assert read_physical(spark, f"{base}/dst").count() == 2
