"""Per-run tables, run changes, acceptance bars and probe loads on literal data and against the direct reports."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from invlens.functions.scalars import windows_path
from invlens.operators.aggregates import merged_histogram, quantiles_of_histogram, two_level_running_totals, value_histogram
from invlens.operators.compare import changes_by_dept, file_changes
from invlens.plans import acl, age, capacity, cost, directory, duplicates, export_batch, mergeable, overview, ownership, physical, size, summary
from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS
from invlens.sources import probes
from invlens.sources.fixture import AS_OF, fixture_inventory
from invlens.sources.inventory import read_inventory, read_physical, write_bucketed, write_inventory
from invlens.streaming import distinct_probes, load_probe_stream, start_monitor, with_progress

RUN, BEFORE = "run-2", "run-1"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def inventory(spark, rows):
    """Rows of (run, uri, path, size, owner), other columns NULL."""
    given = {"run_id": 0, "file_uri": 1, "file_path": 2, "size": 3, "owner_name": 4}
    data = [tuple(r[given[f.name]] if f.name in given else ("f" if f.name == "filename" else None) for f in SCAN_RESULTS.fields) for r in rows]
    return spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.dataType) for f in SCAN_RESULTS.fields]))


def probe_rows(spark, rows):
    at = dt.datetime(2024, 6, 1, 12)
    return spark.createDataFrame([(r, u, a, at + dt.timedelta(hours=h)) for r, u, a, h in rows], "run_id string, file_uri string, allocated long, probed_at timestamp_ntz").select(*FILE_PHYSICAL.names)


@pytest.fixture(scope="module")
def stored(spark, scratch):
    path = tempfile.mkdtemp(prefix="runs-inv-", dir=scratch) + "/t"
    write_inventory(fixture_inventory(spark, SF_SMALL), path, num_files=3)
    return read_inventory(spark, path)


# ------------------------------------------------------------- summary table and export
def test_summary_gives_the_direct_reports(spark, scratch, stored):
    path = tempfile.mkdtemp(prefix="summary-", dir=scratch) + "/t"
    summary.add_run_summary(stored, BEFORE, AS_OF, path)
    first = rows_of(summary.read_summary(spark, path, BEFORE))
    table = summary.add_run_summary(stored, RUN, AS_OF, path)
    assert rows_of(summary.read_summary(spark, path, BEFORE)) == first  # the other run is not touched
    direct = export_batch.standard_reports(stored.where(F.col("run_id") == RUN), AS_OF)
    for name, got in summary.summary_reports(table).items():
        assert got.dtypes == direct[name].dtypes, name
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in direct[name].collect()], name
    rows = table.count()
    assert summary.add_run_summary(stored, RUN, AS_OF, path).count() == rows  # again: replaced, not added


def test_summary_of_odd_rows(spark, scratch):
    """NULL keys are groups of their own and not mixed up with keys that a grain leaves out; an empty run has empty reports."""
    inv = inventory(spark, [(RUN, "a", "/S/Shared/IT/x/", 5, None), (RUN, "b", None, None, "DEMO\\svc_a"), (RUN, "c", "", 7, "")])
    s = summary.summarize(inv, RUN, AS_OF)
    assert {r["kind"]: r["n"] for r in s.groupBy("kind").agg(F.sum("files").alias("n")).collect()} == {k: 3 for k in summary.GRAINS}
    direct = export_batch.standard_reports(inv, AS_OF)
    for name, got in summary.summary_reports(s).items():
        assert rows_of(got) == rows_of(direct[name]), name
    empty = summary.summary_reports(summary.summarize(inv, "no-such-run", AS_OF))
    direct = export_batch.standard_reports(inv.where("false"), AS_OF)
    for name, got in empty.items():
        if name not in ("overview", "protected-dacl", "tree-depth"):
            assert rows_of(got) == rows_of(direct[name]) == [], name
    assert rows_of(empty["protected-dacl"]) == rows_of(direct["protected-dacl"])


def test_export_methods_write_the_same_csv(spark, scratch, stored):
    base = tempfile.mkdtemp(prefix="export-", dir=scratch)
    for method in ("direct", "summary"):
        status = export_batch.export_standard(spark, stored, RUN, AS_OF, f"{base}/{method}", method=method)
        assert status.count() == 20 and status.where("NOT ok").count() == 0
    for name in export_batch.standard_reports(stored, AS_OF):
        a, b = (spark.read.text(f"{base}/{m}/{name}").collect() for m in ("direct", "summary"))
        assert a == b, name
    with pytest.raises(ValueError):
        export_batch.export_standard(spark, stored, RUN, AS_OF, base, method="other")


def test_summary_export_plans_read_the_inventory_twice_more(spark, scratch, stored):
    """Summary, size histogram, duplicates: three scans of the inventory for twenty reports."""
    path = tempfile.mkdtemp(prefix="summary-", dir=scratch) + "/t"
    table = summary.add_run_summary(stored, RUN, AS_OF, path)
    inv_path = stored.inputFiles()[0].split("/run_id=")[0]
    reading = [n for n, df in export_batch.standard_reports_from_summary(table, stored, RUN).items() if any(inv_path in f for f in df.inputFiles())]
    assert sorted(reading) == ["duplicate-floor", "median-file-size"]
    one = summary.summarize(stored, RUN, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("Relation [") == 1


# ------------------------------------------------------------- merging tables
def test_histograms_add_up_to_the_direct_quantiles(spark, scratch, stored):
    path = tempfile.mkdtemp(prefix="hist-", dir=scratch) + "/t"
    for run in (BEFORE, RUN):
        table = mergeable.add_run_histograms(stored, run, path)
    qs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for runs in (None, [RUN], [BEFORE]):
        some = stored if runs is None else stored.where(F.col("run_id").isin(*runs))
        want = sorted(r["size"] for r in some.select("size").collect())
        got = mergeable.quantiles_of_runs(table, "size", qs, runs).first()
        assert (got["n"], got["sum"], got["min"], got["max"]) == (len(want), sum(want), want[0], want[-1])
        assert [got[k] for k in qs] == [want[min(len(want) - 1, int(q * len(want)))] for q in qs.values()]
    with pytest.raises(ValueError):
        mergeable.measured("weight")


def test_merged_histogram_of_literals(spark):
    a = value_histogram(spark.createDataFrame([(1,), (1,), (None,), (9,)], "x long"), "x")
    b = value_histogram(spark.createDataFrame([(1,), (5,)], "x long"), "x")
    assert rows_of(merged_histogram(a.unionByName(b))) == [(1, 3), (5, 1), (9, 1)]
    row = quantiles_of_histogram(merged_histogram(a.unionByName(b)), {"m": 0.5}, summary=True).first()
    assert (row["m"], row["n"], row["sum"]) == (1, 5, 17)


def test_sketches_stay_within_their_error(spark, scratch):
    """Distinct counts and quantiles of two overlapping runs of 60,000 files from merged sketches."""
    n = 60_000
    files = spark.range(n).select(
        F.lit(RUN).alias("run_id"), F.concat(F.lit("/S/Shared/IT/"), "id", F.lit("/")).alias("file_path"), F.concat(F.lit("s"), F.col("id") % 30_000).alias("owner_sid"), (F.col("id") * 7).alias("size")
    )
    again = files.withColumn("run_id", F.lit(BEFORE)).withColumn("file_path", F.concat(F.lit("/S/Shared/IT/"), F.col("size") / 7 + n // 2, F.lit("/")))
    path = tempfile.mkdtemp(prefix="sk-", dir=scratch) + "/t"
    for run in (RUN, BEFORE):
        table = mergeable.add_run_sketches(files.unionByName(again), run, path)
    row = mergeable.distinct_of_runs(table, by=()).first()
    assert row["files"] == 2 * n
    assert abs(row["owners"] - 30_000) <= 4 * mergeable.HLL_ERROR * 30_000
    one = mergeable.distinct_of_runs(table, by=("run_id",), run_ids=[RUN]).first()
    assert one["run_id"] == RUN and abs(one["folders"] - n) <= 4 * mergeable.HLL_ERROR * n
    q = mergeable.approximate_quantiles_of_runs(table, {"p50": 0.5, "p90": 0.9}).first()
    assert abs(q["p50"] / 7 / n - 0.5) < 0.01 and abs(q["p90"] / 7 / n - 0.9) < 0.01


def test_two_level_running_totals_equal_one_window(spark):
    data = [(k, b, o, v) for k, b, o, v in [("a", 1, 1, 5), ("a", 1, 2, 1), ("a", 3, 7, 4), (None, 1, 1, 2), (None, 2, 3, 8), ("b", None, None, 3)]]
    df = spark.createDataFrame(data, "k string, b int, o int, v long")
    got = {tuple(r)[:3]: r["cum"] for r in two_level_running_totals(df, ["k"], "b", "o", {"cum": "v"}).collect()}
    assert got == {("a", 1, 1): 5, ("a", 1, 2): 6, ("a", 3, 7): 10, (None, 1, 1): 2, (None, 2, 3): 10, ("b", None, None): 3}
    assert two_level_running_totals(df.where("false"), ["k"], "b", "o", {"cum": "v"}).count() == 0


def test_daily_trend_has_no_window_over_everything(stored):
    plan = age.cumulative_trend_daily(stored, RUN, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


# ------------------------------------------------------------- run changes
def test_file_changes_literal(spark):
    inv = inventory(
        spark,
        [
            (BEFORE, "same", "/S/Shared/IT/", 1, "o"), (RUN, "same", "/S/Shared/IT/", 1, "o"),
            (BEFORE, "grown", "/S/Shared/IT/", 1, "o"), (RUN, "grown", "/S/Shared/HR/", 5, "o"),
            (BEFORE, "owned", "/S/Shared/IT/", None, None), (RUN, "owned", "/S/Shared/IT/", None, "o"),
            (BEFORE, "gone", "/S/Shared/IT/", 3, "o"), (RUN, "new", "/S/Shared/IT/", 4, "o"),
            (BEFORE, None, "/S/Shared/IT/", 2, None), (RUN, None, "/S/Shared/IT/", 2, None),
            ("run-0", "other", "/S/Shared/IT/", 9, "o"),
        ],
    )
    got = {r["file_uri"]: (r["dept"], r["change"], r["resized"], r["reowned"]) for r in file_changes(inv, BEFORE, RUN).collect()}
    assert got == {
        "same": ("IT", "kept", False, False), "grown": ("HR", "kept", True, False), "owned": ("IT", "kept", False, True),
        "gone": ("IT", "removed", False, False), "new": ("IT", "added", False, False), None: ("IT", "kept", False, False),
    }
    dept = {r["dept"]: r for r in changes_by_dept(inv, BEFORE, RUN).collect()}
    assert (dept["IT"]["added"], dept["IT"]["removed"], dept["IT"]["reowned"], dept["IT"]["unchanged"], dept["IT"]["bytes_delta"]) == (1, 1, 1, 2, 1)
    assert dept["HR"]["resized"] == 1 and dept["HR"]["bytes_delta"] == 4


def test_file_changes_on_bucketed_table_need_no_shuffle(spark, scratch):
    path = tempfile.mkdtemp(prefix="bucketed-", dir=scratch) + "/t"
    write_bucketed(fixture_inventory(spark, SF_SMALL), "changes_bucketed", path, 4)
    df = file_changes(spark.table("changes_bucketed"), BEFORE, RUN)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows_of(df) == rows_of(file_changes(fixture_inventory(spark, SF_SMALL), BEFORE, RUN))


# ------------------------------------------------------------- acceptance and outcomes
def test_acceptance_bars(spark):
    files = [(RUN, f"win://h/S/{i}", "/S/Shared/IT/", 100, "o") for i in range(30)]
    inv = inventory(spark, files)
    good = probe_rows(spark, [(RUN, u, 100, 0) for _, u, *_ in files])
    again = good.select("file_uri", "allocated")
    bars = {r["bar"]: (r["value"], r["expected"], r["ok"]) for r in physical.acceptance_check(inv, good, RUN, 3100, again).collect()}
    assert bars == {"row_count": (30.0, 30.0, True), "allocated_total": (3000.0, 3100.0, True), "spot_check": (20.0, 20.0, True), "missing_share": (0.0, 0.001, True)}
    sampled = [r["file_uri"] for r in physical.spot_sample(inv, RUN).collect()]
    assert len(sampled) == 20 and sampled == [r["file_uri"] for r in physical.spot_sample(inv.repartition(7), RUN).collect()]
    bad = good.where(F.col("file_uri") != sampled[0]).unionByName(probe_rows(spark, [(RUN, sampled[1], 900, 1)]))
    bars = {r["bar"]: r["ok"] for r in physical.acceptance_check(inv, bad, RUN, 3000, again).collect()}
    assert bars == {"row_count": False, "allocated_total": False, "spot_check": False, "missing_share": False}
    none = {r["bar"]: r["ok"] for r in physical.acceptance_check(inv.where("false"), good, RUN, 0, again).collect()}
    assert none["missing_share"] and none["row_count"]


def test_probe_outcomes_and_remaining_feed(spark, scratch):
    inv = inventory(spark, [(RUN, "win://h/S/a", "/p/", 1, "o"), (RUN, "win://h/S/b", "/p/", 1, "o"), (RUN, "nfs://h/c", "/p/", 1, "o"), (BEFORE, "win://h/S/a", "/p/", 1, "o")])
    phys = probe_rows(spark, [(RUN, "win://h/S/a", 1, 0), (RUN, "win://h/S/a", 2, 1), (RUN, "win://h/S/z", 1, 0)])
    got = {(r["run_id"], r["file_uri"]): (r["win_path"], r["outcome"]) for r in probes.probe_outcomes(inv, phys).collect()}
    assert got == {
        (RUN, "win://h/S/a"): ("S:\\a", "OK"), (RUN, "win://h/S/b"): ("S:\\b", "MISSING"), (RUN, "nfs://h/c"): (None, "PATH_CONVERT"),
        (RUN, "win://h/S/z"): (None, "NOT_IN_RUN"), (BEFORE, "win://h/S/a"): ("S:\\a", "MISSING"),
    }
    path = tempfile.mkdtemp(prefix="outcomes-", dir=scratch) + "/t"
    for run in (BEFORE, RUN, RUN):  # a repeated run replaces itself and leaves the other
        probes.write_probe_outcomes(inv, phys, path, run)
    assert spark.read.parquet(path).count() == 5 and os.path.isdir(f"{path}/run_id={RUN}/outcome=PATH_CONVERT")
    assert rows_of(probes.remaining_feed(inv, phys, RUN)) == [(RUN, "win://h/S/b")]


def test_remaining_feed_tests_uris_without_building_paths(spark):
    uris = ["win://h/S/a", "WIN://H/s/", "win://h/S/100%", "win://h/S/%zz+b", "win://h/S/%FF", "win://h/Shared/x", "win:///S/x", "nfs://h/c", "win://h/S/a\nb", "", None]
    inv = inventory(spark, [(RUN, u, "/p/", 1, "o") for u in uris])
    left = probes.remaining_feed(inv, probe_rows(spark, [(RUN, "win://h/S/a", 1, 0)]), RUN)
    want = inv.where(windows_path("file_uri").isNotNull() & (F.col("file_uri") != "win://h/S/a")).select("run_id", "file_uri")
    assert rows_of(left) == rows_of(want) and want.count() >= 4
    assert "url_decode" not in left._jdf.queryExecution().toString().lower()


# ------------------------------------------------------------- probe loads
def _lines(path, name, rows):
    with open(os.path.join(path, name), "w") as fh:
        fh.write("".join(f"{r}\t{u}\t{a}\n" for r, u, a in rows))


def test_distinct_progress_survives_restart_and_reprobes(spark, scratch):
    table, ckpt = tempfile.mkdtemp(prefix="dp-", dir=scratch) + "/t", tempfile.mkdtemp(prefix="ck-", dir=scratch)
    expected = spark.createDataFrame([(RUN, 4), (BEFORE, 1), ("run-0", 3)], "run_id string, expected long")
    loads = [
        [(RUN, "a", 1, 0), (RUN, "b", 1, 0), (RUN, "a", 2, 1)],
        [(RUN, "a", 3, 2), (RUN, "c", 1, 2), (BEFORE, "a", 1, 2)],  # after a restart: a again, and a in another run
    ]
    want = [{RUN: (2, False), BEFORE: (0, False), "run-0": (0, False)}, {RUN: (3, False), BEFORE: (1, True), "run-0": (0, False)}]
    for load, result in zip(loads, want, strict=True):
        probes.append_physical(probe_rows(spark, load), table)
        stream = spark.readStream.schema("file_uri string, allocated long, probed_at timestamp_ntz, run_id string").parquet(table)
        start_monitor(distinct_probes(stream), "distinct_test", ckpt, available_now=True).awaitTermination()
        got = with_progress(spark.table("distinct_test"), expected).collect()
        assert {r["run_id"]: (r["files_probed"], r["done"]) for r in got} == result


def test_load_killed_halfway_is_fed_again(spark, scratch):
    """A load dies after its first micro-batch; the next feed is the gap, and every file is there once, in the ledger too."""
    src, base = tempfile.mkdtemp(prefix="kill-src-", dir=scratch), tempfile.mkdtemp(prefix="kill-", dir=scratch)
    table, ckpt = f"{base}/t", f"{base}/ck"
    files = [f"win://h/S/{i}" for i in range(10)]
    inv = inventory(spark, [(RUN, u, "/p/", 1, "o") for u in files])
    _lines(src, "1.tsv", [(RUN, u, 1) for u in files[:4]])
    load_probe_stream(spark, src, table, ckpt).awaitTermination()
    left = sorted(r["file_uri"] for r in probes.remaining_feed(inv, read_physical(spark, table), RUN).collect())
    assert left == files[4:]
    _lines(src, "2.tsv", [(RUN, u, 1) for u in left])
    load_probe_stream(spark, src, table, ckpt).awaitTermination()
    phys = read_physical(spark, table)
    assert sorted(r["file_uri"] for r in phys.collect()) == files
    assert probes.remaining_feed(inv, phys, RUN).isEmpty()
    ledger = [(r["run_id"], r["rows"], r["allocated"], r["rejected"]) for r in probes.read_load_ledger(spark, table).orderBy("rows").collect()]
    assert ledger == [(RUN, 4, 4, 0), (RUN, 6, 6, 0)]


def test_repeated_micro_batch_is_in_table_and_ledger_once(spark, scratch, monkeypatch):
    """The load fails between landing and the ledger; on the next start the micro-batch is repeated and replaces itself."""
    from invlens.streaming import monitor

    src, base = tempfile.mkdtemp(prefix="rep-src-", dir=scratch), tempfile.mkdtemp(prefix="rep-", dir=scratch)
    _lines(src, "1.tsv", [(RUN, "win://h/S/a", 1), (BEFORE, "win://h/S/b", 2)])
    whole = monitor.probe_result_rejects

    def dies(lines):
        raise RuntimeError("killed")

    monkeypatch.setattr(monitor, "probe_result_rejects", dies)
    with pytest.raises(Exception):
        load_probe_stream(spark, src, f"{base}/t", f"{base}/ck").awaitTermination()
    monkeypatch.setattr(monitor, "probe_result_rejects", whole)
    load_probe_stream(spark, src, f"{base}/t", f"{base}/ck").awaitTermination()
    assert rows_of(read_physical(spark, f"{base}/t").select("run_id", "file_uri", "allocated")) == [(BEFORE, "win://h/S/b", 2), (RUN, "win://h/S/a", 1)]
    assert rows_of(probes.read_load_ledger(spark, f"{base}/t").select("run_id", "rows")) == [(BEFORE, 1), (RUN, 1)]


# ------------------------------------------------------------- files only, fees
REPORTS = {
    "total_files": (overview.total_files, {}), "overview": (overview.overview, {"as_of": AS_OF}), "dept": (capacity.dept_breakdown, {"pct": True}),
    "year": (capacity.year_histogram, {}), "flags": (acl.acl_flag_distribution, {}), "owners": (ownership.ownership_split, {}),
    "age": (age.age_bands, {"as_of": AS_OF}), "buckets": (size.size_buckets, {}), "quantiles": (size.size_quantiles, {}),
    "floor": (duplicates.duplicate_floor, {}), "cost": (cost.hot_cost, {}), "usage": (directory.directory_usage, {}),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_files_only(stored, name):
    fn, kw = REPORTS[name]
    assert rows_of(fn(stored, RUN, files_only=True, **kw)) == rows_of(fn(stored.where(F.col("filename") != ""), RUN, **kw))


def test_files_only_drops_directories_in_the_scan(stored):
    n = stored.where((F.col("run_id") == RUN) & (F.col("filename") == "")).count()
    whole, files = (overview.total_files(stored, RUN, files_only=x).first()["files"] for x in (False, True))
    assert n > 0 and whole - files == n
    assert "Not(EqualTo(filename,))" in overview.total_files(stored, RUN, files_only=True)._jdf.queryExecution().executedPlan().toString()


def test_cost_model_formula(spark):
    tib = 1 << 40
    old, new = dt.datetime(2010, 1, 1), dt.datetime(2024, 5, 1)
    inv = inventory(spark, [(RUN, "a", "/p/", 3 * tib, "o"), (RUN, "b", "/p/", tib, "o")]).withColumn(
        "last_accessed", F.when(F.col("file_uri") == "a", F.lit(old)).otherwise(F.lit(new)).cast("timestamp_ntz")
    )
    row = cost.cost_model(inv, RUN, AS_OF, 10.0, 2.0, egress_rate=4.0, retrieval_rate=1.0, request_rate=100.0, recalled_share=0.5).first()
    assert (row["frozen_files"], row["cost_now"], row["storage"]) == (1, 40.0, 16.0)
    assert row["fees"] == 0.5 * (3 * 5.0 + 0.1) and row["savings"] == 40.0 - 16.0 - row["fees"]
    plain = cost.cost_model(inv, RUN, AS_OF).first()
    assert plain["fees"] == 0 and plain["savings"] == pytest.approx(cost.archive_savings(inv, RUN, AS_OF).first()["savings"])
