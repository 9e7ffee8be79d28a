"""Registered entries for per-run tables, run comparison, probe loads and the varied inventory.

Registered into the same list as ``invlens.catalog``, which imports this
module. Entries that need stored tables write them under the session's
checkpoint folder, settle the (small) answer and remove them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens import oracle_sql as O
from invlens.catalog import ACL_PATTERN, H, P, PARENT, R, RUN, S0, SI, W, inv_report, register
from invlens.operators.compare import changes_by_dept, file_changes
from invlens.operators.joins import orphan_probes
from invlens.plans import acl, age, capacity, cost, duplicates, mergeable, overview, ownership, physical, size, summary
from invlens.plans.directory import source_slice
from invlens.plans.runs import run_trend
from invlens.session import checkpoint_dir
from invlens.sources import probes
from invlens.sources.export import export_reports
from invlens.sources.fixture import AS_OF, PREVIOUS_RUN, PROBE_TS, VARIED_SQL, fixture_inventory, fixture_tables, varied_inventory, varied_tables
from invlens.sources.inventory import read_inventory, read_physical, read_report_csv, write_inventory, write_physical

RUNS = (PREVIOUS_RUN, RUN)


@contextmanager
def _folder(spark: SparkSession, kind: str):
    """A folder under the checkpoint folder, removed afterwards."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/invlens-{kind}-{uuid.uuid4().hex[:12]}"
    try:
        yield base
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _settled(df: DataFrame) -> DataFrame:
    """The rows of a report whose size does not grow with the files (per run, department, band or class)."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


# ---------------------------------------------------------------- summary table
def _long(name: str, key: str, where: str = "TRUE", having: str = "TRUE", size_of: str = S0("size"), limit: str = "") -> str:
    return (
        f"SELECT * FROM (SELECT '{name}' AS report, CAST({key} AS VARCHAR) AS key, count(*) AS files, {size_of} AS bytes "
        f"FROM scan_results WHERE {R} AND {where} GROUP BY 2 HAVING {having} {limit})"
    )


def _bands(edges, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN size < {upper} THEN '{label}'" for upper, label in edges) + f" ELSE '{rest}' END"


_OWNER_CLASS = f"CASE WHEN {O.ORPHAN} THEN 'OrphanSid' WHEN {O.SVC} THEN 'ServiceAccount' WHEN owner_name = {O.BUILTIN} THEN 'BuiltinAdmin' WHEN {O.GG} THEN 'DeptGroup' ELSE 'User' END"
_ACCESS = (
    f"CASE WHEN last_accessed > {O.ago(90, 'DAY')} THEN '1_Active_lt90d' WHEN last_accessed > {O.ago(1, 'YEAR')} THEN '2_Warm_90d-1y' "
    f"WHEN last_accessed > {O.ago(3, 'YEAR')} THEN '3_Cold_1-3y' ELSE '4_Frozen_3yplus' END"
)


@register(
    "summary_reports",
    W(
        " UNION ALL ".join(
            [
                _long("dept-breakdown", O.DEPT, f"{O.DEPT} <> ''"),
                _long("year-distribution", "year(created)", "year(created) BETWEEN 2015 AND 2027"),
                _long("acl-analysis-flags", "acl_analysis", size_of="CAST(NULL AS BIGINT)", limit="ORDER BY files DESC, key LIMIT 50"),
                _long("ownership", _OWNER_CLASS),
                _long("extensions-by-bytes", "extension", limit="ORDER BY bytes DESC, key LIMIT 25"),
                _long("size-buckets", _bands(size.LOG_SIZE_BUCKETS, size.LOG_SIZE_REST)),
                _long("size-distribution-6band", _bands(size.SIZE_BANDS, size.SIZE_BANDS_REST)),
                _long("top-orphan-sids", "owner_sid", O.ORPHAN, limit="ORDER BY files DESC, key LIMIT 25"),
                _long("service-accounts", "owner_name", O.SVC),
                _long("chargeback", f"CASE WHEN {O.GG} THEN owner_name ELSE 'UNATTRIBUTABLE' END"),
                _long("age-bands-last-accessed", _ACCESS),
            ]
        )
    ),
)
def _summary_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven standard reports rolled up from the stored summary table of a run; the other run's summary stands beside it."""
    inv = fixture_inventory(spark, sf)
    with _folder(spark, "summary") as base:
        for run in RUNS:
            summary.add_run_summary(inv, run, AS_OF, base)
        return _settled(summary.rolled_up(summary.read_summary(spark, base, RUN)))


# ---------------------------------------------------------------- tables that merge over runs
_QS = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def _quantile_sql(value: str, where: str) -> str:
    ranked = f"ranked AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS rn, count(*) OVER () AS n FROM scan_results WHERE {where})"
    cols = ", ".join(f"{O.quantile_at(q)} AS {k}" for k, q in _QS.items())
    return W(f"SELECT {cols}, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max FROM ranked", ranked)


def _merged_quantiles(measure: str, runs):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        inv = fixture_inventory(spark, sf)
        with _folder(spark, "histograms") as base:
            for run in RUNS:
                table = mergeable.add_run_histograms(inv, run, base, [measure])
            return _settled(mergeable.quantiles_of_runs(table, measure, _QS, runs))

    return build


register("merged_size_quantiles", _quantile_sql("size", "TRUE"))(_merged_quantiles("size", None))
register("merged_size_quantiles_one_run", _quantile_sql("size", R))(_merged_quantiles("size", [RUN]))
register("merged_depth_quantiles", _quantile_sql(f"CAST({O.DEPTH} AS BIGINT)", "file_path <> ''"))(_merged_quantiles("depth", None))


@register(
    "merged_distinct_counts",
    W(
        f"SELECT {O.DEPT} AS dept, count(*) AS files, count(DISTINCT owner_sid) AS owners, count(DISTINCT file_path) AS folders, TRUE AS names_within_error "
        "FROM scan_results GROUP BY 1"
    ),
)
def _merged_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct owners and folders over both runs from stored sketches, exact at these counts, and whether the sketched
    number of file names lies within four standard errors of the exact one."""
    inv = fixture_inventory(spark, sf)
    with _folder(spark, "sketches") as base:
        for run in RUNS:
            table = mergeable.add_run_sketches(inv, run, base)
        named = inv.select(capacity.dept().alias("dept"), "filename").groupBy("dept").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("filename", mergeable.HLL_REGISTERS_LOG2)).alias("_about"), F.count_distinct("filename").alias("_names")
        )
        out = mergeable.distinct_of_runs(table).join(named, "dept")
        within = F.abs(F.col("_about") - F.col("_names")) <= 4 * mergeable.HLL_ERROR * F.col("_names") + 0.5
        return _settled(out.select("dept", "files", "owners", "folders", within.alias("names_within_error")))


# ---------------------------------------------------------------- run comparison at file grain
_SIDES = (
    f"m AS (SELECT COALESCE(a.file_uri, b.file_uri) AS file_uri, CASE WHEN b.file_uri IS NULL THEN 'added' WHEN a.file_uri IS NULL THEN 'removed' ELSE 'kept' END AS change, "
    "COALESCE(a.dept, b.dept) AS dept, b.size AS bytes_before, a.size AS bytes_after, "
    "a.file_uri IS NOT NULL AND b.file_uri IS NOT NULL AND a.size IS DISTINCT FROM b.size AS resized, "
    "a.file_uri IS NOT NULL AND b.file_uri IS NOT NULL AND a.owner_name IS DISTINCT FROM b.owner_name AS reowned "
    f"FROM (SELECT *, {O.DEPT} AS dept FROM scan_results WHERE run_id = '{RUN}') a FULL OUTER JOIN (SELECT *, {O.DEPT} AS dept FROM scan_results WHERE run_id = '{PREVIOUS_RUN}') b ON a.file_uri = b.file_uri)"
)
inv_report(
    "run_changes_by_dept",
    W(
        "SELECT dept, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count_if(resized) AS resized, count_if(reowned) AS reowned, "
        "count_if(change = 'kept' AND NOT resized AND NOT reowned) AS unchanged, CAST(sum(COALESCE(bytes_after, 0) - COALESCE(bytes_before, 0)) AS BIGINT) AS bytes_delta FROM m GROUP BY dept",
        _SIDES,
    ),
    changes_by_dept,
    run_before=PREVIOUS_RUN,
    run_after=RUN,
)
inv_report(
    "run_changed_files",
    W("SELECT file_uri, dept, change, resized, reowned, bytes_before, bytes_after FROM m WHERE change <> 'kept' OR resized OR reowned", _SIDES),
    lambda inv: file_changes(inv, PREVIOUS_RUN, RUN).where("change <> 'kept' OR resized OR reowned"),
)

# ---------------------------------------------------------------- long series, fees, files only
inv_report(
    "cumulative_trend_daily",
    W(
        "SELECT dept, day, files, bytes, CAST(sum(files) OVER w AS BIGINT) AS cum_files, CAST(sum(bytes) OVER w AS BIGINT) AS cum_bytes FROM "
        f"(SELECT {O.DEPT} AS dept, CAST(created AS DATE) AS day, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND created >= {O.ago(30, 'YEAR')} AND created < {O.AS_OF_TS} GROUP BY 1, 2) "
        "WINDOW w AS (PARTITION BY dept ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ),
    age.cumulative_trend_daily,
    run_id=RUN,
    as_of=AS_OF,
)
_FROZEN = O.stale("last_accessed", 3)
inv_report(
    "cost_model_with_fees",
    W(
        "SELECT frozen_files, a * 23.0::DOUBLE AS cost_now, (a - f) * 23.0::DOUBLE + f * 4.0::DOUBLE AS storage, "
        "0.1::DOUBLE * (f * 115.0::DOUBLE + frozen_files / 1000.0::DOUBLE * 0.05::DOUBLE) AS fees, "
        "a * 23.0::DOUBLE - ((a - f) * 23.0::DOUBLE + f * 4.0::DOUBLE) - 0.1::DOUBLE * (f * 115.0::DOUBLE + frozen_files / 1000.0::DOUBLE * 0.05::DOUBLE) AS savings FROM "
        f"(SELECT count_if({_FROZEN}) AS frozen_files, {O.dbl(S0('size'))} / {O.TIB} AS a, {O.dbl(SI(_FROZEN))} / {O.TIB} AS f FROM scan_results WHERE {R})"
    ),
    cost.cost_model,
    run_id=RUN,
    as_of=AS_OF,
    egress_rate=90.0,
    retrieval_rate=25.0,
    request_rate=0.05,
    recalled_share=0.1,
)
inv_report("total_files_only", W(f"SELECT count(*) AS files FROM scan_results WHERE {R} AND {O.IS_FILE}"), overview.total_files, run_id=RUN, files_only=True)
inv_report(
    "dept_breakdown_files_only",
    W(
        f"SELECT {O.DEPT} AS dept, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human, "
        f"{P('sum(size)', f'(SELECT sum(size) FROM scan_results WHERE {R} AND {O.IS_FILE})')} AS pct_bytes "
        f"FROM scan_results WHERE {R} AND {O.IS_FILE} GROUP BY 1 HAVING {O.DEPT} <> ''"
    ),
    capacity.dept_breakdown,
    run_id=RUN,
    pct=True,
    files_only=True,
)


inv_report(
    "kpis",
    W(
        f"SELECT *, epoch_ms(oldest_modified) AS oldest, {P('orphans', 'files', None)} AS pct_orphan, {P('widens', 'files', None)} AS pct_widens, {P('broken', 'files', None)} AS pct_broken, "
        f"{O.dbl('bytes')} / {O.TIB} * 23.0::DOUBLE AS usd_mo, {O.dbl('frozen_bytes')} / {O.TIB} * 19.0::DOUBLE AS savings FROM ("
        f"SELECT count(*) AS files, {S0('size')} AS bytes, count(DISTINCT owner_sid) AS owners, min(modified) AS oldest_modified, count_if({O.ORPHAN}) AS orphans, "
        + ", ".join(f"count_if({O.flag(f)}) AS {n}" for f, n in (("W", "widens"), ("B", "broken"), ("P", "protected"), ("N", "may_narrow")))
        + f", count_if(modified > {O.ago(1, 'DAY')}) AS active, count_if({_FROZEN}) AS dormant_3y, {SI(O.ORPHAN)} AS orphan_bytes, {SI(_FROZEN)} AS frozen_bytes, "
        f"count_if({O.mentions('Everyone')}) AS everyone, count_if(parent_acl <> '' AND acl <> parent_acl) AS naive_broken FROM scan_results WHERE {R})"
    ),
    overview.kpis,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "run_trend_files_only",
    W(
        f"SELECT run_id, max(run_start_time) AS run_start_time, count(*) AS files, {S0('size')} AS bytes, "
        f"count_if({O.ORPHAN}) AS orphan_files, {SI(O.ORPHAN)} AS orphan_bytes FROM scan_results WHERE {O.IS_FILE} GROUP BY run_id"
    ),
    run_trend,
    files_only=True,
)


# ---------------------------------------------------------------- probe loads
@register(
    "probe_completion_stream",
    W(
        "SELECT e.run_id, count(p.file_uri) AS files_probed, any_value(expected) AS expected, 100.0::DOUBLE * count(p.file_uri) / any_value(expected) AS pct_done, "
        "count(p.file_uri) >= any_value(expected) AS done "
        f"FROM (SELECT run_id, count(*) AS expected FROM scan_results WHERE {O.IS_FILE} GROUP BY run_id) e "
        "LEFT JOIN (SELECT DISTINCT run_id, file_uri FROM file_physical) p ON p.run_id = e.run_id GROUP BY e.run_id"
    ),
)
def _probe_completion_stream(spark: SparkSession, sf: str) -> DataFrame:
    """M2 exact and live: first probes land, a stream counts different files; then re-probes and a
    repeat of some first probes land, and the stream, started anew from its checkpoint, counts on."""
    from invlens.streaming import distinct_probes, start_monitor, with_progress

    inv, phys = fixture_tables(spark, sf)
    first = F.col("probed_at") == F.lit(PROBE_TS[0]).cast("timestamp_ntz")
    early = F.length("file_uri") % 2 == 0
    expected = probes.probe_feed(inv).groupBy("run_id").agg(F.count(F.lit(1)).alias("expected"))
    name = f"distinct_probes_{uuid.uuid4().hex[:12]}"
    with _folder(spark, "completion") as base:
        for part in (first & early, ~first | ~early):
            probes.append_physical(phys.where(part), f"{base}/table")
            stream = spark.readStream.schema("file_uri string, allocated long, probed_at timestamp_ntz, run_id string").parquet(f"{base}/table")
            query = start_monitor(distinct_probes(stream), name, f"{base}/checkpoint", available_now=True)
            query.awaitTermination()
        return _settled(with_progress(spark.table(name), expected))


@register(
    "probe_restart",
    W(
        f"SELECT run_id, count(*) AS files, count(*) AS probes, CAST(sum(CASE WHEN size < 131072 THEN size ELSE 131072 END) AS BIGINT) AS allocated, CAST(2 AS BIGINT) AS loads, "
        f"CAST(count(*) AS BIGINT) AS ledger_rows, CAST(0 AS BIGINT) AS remaining FROM scan_results WHERE {O.IS_FILE} GROUP BY run_id"
    ),
)
def _probe_restart(spark: SparkSession, sf: str) -> DataFrame:
    """M3 from the gap: a load breaks off after half of the files; the next feed is what the table lacks, and then nothing is left."""
    from invlens.streaming import load_probe_stream

    inv = fixture_inventory(spark, sf)
    measured = F.when(F.col("size") < 131072, F.col("size")).otherwise(F.lit(131072)).cast("string")  # stands for the walker's call

    def walk(feed: DataFrame, to: str) -> None:
        rows = feed.join(inv.select("run_id", "file_uri", "size"), ["run_id", "file_uri"])
        rows.select(F.concat_ws("\t", "run_id", "file_uri", measured).alias("value")).write.mode("append").text(to)

    with _folder(spark, "restart") as base:
        table = f"{base}/table"
        walk(probes.probe_feed(inv).where(F.length("file_uri") % 2 == 0), f"{base}/lines")
        load_probe_stream(spark, f"{base}/lines", table, f"{base}/checkpoint").awaitTermination()
        walk(probes.remaining_feed(inv, read_physical(spark, table)), f"{base}/lines")
        load_probe_stream(spark, f"{base}/lines", table, f"{base}/checkpoint").awaitTermination()
        phys = read_physical(spark, table)
        left = probes.remaining_feed(inv, phys).groupBy("run_id").agg(F.count(F.lit(1)).alias("remaining"))
        ledger = probes.read_load_ledger(spark, table).groupBy("run_id").agg(F.count_distinct("load_id").alias("loads"), F.sum("rows").alias("ledger_rows"))
        out = phys.groupBy("run_id").agg(F.count_distinct("file_uri").alias("files"), F.count(F.lit(1)).alias("probes"), F.sum("allocated").alias("allocated"))
        out = out.join(ledger, "run_id").join(left, "run_id", "left")
        return _settled(out.select("run_id", "files", "probes", "allocated", "loads", "ledger_rows", F.coalesce("remaining", F.lit(0).cast("long")).alias("remaining")))


@register(
    "acceptance_check",
    W(
        "SELECT bar, value, expected, ok FROM (SELECT unnest(["
        "{'bar': 'row_count', 'value': CAST(probed AS DOUBLE), 'expected': CAST(files AS DOUBLE), 'ok': probed = files}, "
        "{'bar': 'allocated_total', 'value': CAST(total AS DOUBLE), 'expected': CAST(wanted AS DOUBLE), 'ok': abs(total - wanted) <= 0.05::DOUBLE * wanted}, "
        "{'bar': 'spot_check', 'value': CAST(matched AS DOUBLE), 'expected': 20.0::DOUBLE, 'ok': matched = 20}, "
        "{'bar': 'missing_share', 'value': CAST(files - probed AS DOUBLE) / files, 'expected': 0.001::DOUBLE, 'ok': CAST(files - probed AS DOUBLE) / files < 0.001}], recursive := true) FROM t)",
        f"{O.LATEST}, f AS (SELECT file_uri, size, md5(file_uri) AS h FROM scan_results WHERE {R} AND {O.IS_FILE}), "
        f"l AS (SELECT * FROM latest WHERE {R}), spot AS (SELECT * FROM f ORDER BY h, file_uri LIMIT 20), "
        "t AS (SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f JOIN l USING (file_uri)) AS probed, (SELECT sum(allocated) FROM f JOIN l USING (file_uri)) AS total, "
        f"(SELECT sum(CASE WHEN size < 131072 THEN size ELSE 131072 END) FROM f) AS wanted, "
        "(SELECT count(*) FROM spot JOIN l USING (file_uri) WHERE allocated = CASE WHEN size < 131072 THEN size ELSE 131072 END) AS matched)",
    ),
)
def _acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """The four acceptance bars; the probes lack some files and some were re-probed with another size, so bars fail."""
    inv, phys = fixture_tables(spark, sf)
    again = probes.probe_feed(inv, RUN).join(inv.where(F.col("run_id") == RUN).select("file_uri", "size"), "file_uri")
    again = again.select("file_uri", F.least("size", F.lit(131072).cast("long")).alias("allocated"))
    return physical.acceptance_check(inv, phys, RUN, again.agg(F.sum("allocated")).scalar(), again)


# ---------------------------------------------------------------- the varied inventory
def V(body: str, ctes: str = "") -> str:
    return W(body, VARIED_SQL + (f", {ctes}" if ctes else ""))


def varied_report(name: str, sql: str, fn, /, **kw):
    register(name, sql)(lambda spark, sf: fn(varied_inventory(fixture_inventory(spark, sf)), **kw))


varied_report("varied_acl_patterns", V(f"SELECT {ACL_PATTERN} AS pattern, count(*) AS files, {S0('size')} AS bytes FROM varied WHERE {R} GROUP BY 1"), acl.acl_pattern_classifier, run_id=RUN)
varied_report("varied_legacy_orphan_count", V(f"SELECT count_if({O.ORPHAN_LEGACY}) AS orphans FROM varied WHERE {R}"), overview.orphan_count, run_id=RUN, mode="legacy")
varied_report("varied_orphan_count", V(f"SELECT count_if({O.ORPHAN}) AS orphans FROM varied WHERE {R}"), overview.orphan_count, run_id=RUN)
varied_report("varied_everyone_count", V(f"SELECT count_if({O.mentions('Everyone')}) AS every FROM varied WHERE {R}"), overview.everyone_count, run_id=RUN)
varied_report("varied_everyone_pct", V(f"SELECT {P(f'count_if({O.mentions('Everyone')})', 'count(*)', None)} AS pct FROM varied WHERE {R}"), overview.pct_everyone_files, run_id=RUN)
varied_report(
    "varied_everyone_paths",
    V(f"SELECT {PARENT} AS parent_dir, count(*) AS files, {S0('size')} AS bytes FROM varied WHERE {R} AND {O.mentions('Everyone')} GROUP BY 1 ORDER BY files DESC, parent_dir LIMIT 50"),
    acl.everyone_paths,
    run_id=RUN,
)
varied_report(
    "varied_service_accounts",
    V(f"SELECT owner_name, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human FROM varied WHERE {R} AND {O.SVC} GROUP BY 1"),
    ownership.service_accounts,
    run_id=RUN,
)
varied_report(
    "varied_source_slice",
    V(f"SELECT regexp_extract(file_uri, '^(win://[^/]+/[^/]+)/', 1) AS source, count(*) AS files, {S0('size')} AS bytes FROM varied WHERE {R} GROUP BY 1"),
    source_slice,
    run_id=RUN,
)
varied_report(
    "varied_acl_folder_summary",
    V(
        f"SELECT file_path, count(*) AS entries, count_if({O.IS_DIR}) AS dirs, "
        + ", ".join(f"count_if({O.flag(f)}) AS flag_{f.lower()}" for f in acl.FOLDER_FLAGS)
        + f" FROM varied WHERE {R} GROUP BY file_path"
    ),
    acl.acl_folder_summary,
    run_id=RUN,
)
varied_report(
    "varied_non_ascii_uris",
    V(f"SELECT count(*) AS rows, count_if(regexp_matches(file_uri, '[^\\x00-\\x7F]')) AS non_ascii_uris FROM varied WHERE {R}"),
    lambda inv: overview.ingest_facts(inv, RUN).select("rows", "non_ascii_uris"),
)
@register(
    "probe_outcomes",
    V(
        "SELECT run_id, outcome, count(*) AS files FROM (SELECT COALESCE(f.run_id, p.run_id) AS run_id, CASE WHEN f.file_uri IS NULL THEN 'NOT_IN_RUN' "
        f"WHEN NOT regexp_matches(f.file_uri, '^win://[^/]+/[A-Za-z]/') THEN 'PATH_CONVERT' WHEN p.file_uri IS NULL THEN 'MISSING' ELSE 'OK' END AS outcome "
        f"FROM (SELECT run_id, file_uri FROM varied WHERE {O.IS_FILE}) f FULL OUTER JOIN (SELECT DISTINCT run_id, file_uri FROM varied_physical) p ON f.run_id = p.run_id AND f.file_uri = p.file_uri) GROUP BY 1, 2"
    ),
)
def _probe_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every fed or probed file in its class, written side by side and counted from what was written."""
    inv, phys = varied_tables(spark, sf)
    with _folder(spark, "outcomes") as base:
        for run in RUNS:
            probes.write_probe_outcomes(inv, phys, base, run)
        written = spark.read.parquet(base).withColumn("run_id", F.col("run_id").cast("string"))
        return _settled(written.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("files")))


register(
    "varied_orphan_probes",
    V("SELECT DISTINCT run_id, file_uri FROM varied_physical p WHERE NOT EXISTS (SELECT 1 FROM varied v WHERE v.run_id = p.run_id AND v.file_uri = p.file_uri)"),
)(lambda spark, sf: orphan_probes(*varied_tables(spark, sf)))


# ---------------------------------------------------------------- stored tables
@register(
    "stored_tables",
    W(
        f"SELECT s.run_id, s.files, s.bytes, COALESCE(p.probes, 0) AS probes FROM (SELECT run_id, count(*) AS files, {S0('size')} AS bytes FROM scan_results GROUP BY run_id) s "
        f"LEFT JOIN (SELECT run_id, count(*) AS probes FROM file_physical WHERE run_id <> '{PREVIOUS_RUN}' GROUP BY run_id) p ON p.run_id = s.run_id"
    ),
)
def _stored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables written by run and read back, one run of the probes dropped."""
    inv, phys = fixture_tables(spark, sf)
    with _folder(spark, "tables") as base:
        write_inventory(inv, f"{base}/scan_results")
        write_physical(phys, f"{base}/file_physical")
        probes.drop_run(spark, PREVIOUS_RUN, path=f"{base}/file_physical")
        files = None
        for run in RUNS:  # one run at a time, as a report reads it
            one = read_inventory(spark, f"{base}/scan_results", run).groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
            files = one if files is None else files.unionByName(one)
        probed = read_physical(spark, f"{base}/file_physical").groupBy("run_id").agg(F.count(F.lit(1)).alias("probes"))
        return _settled(files.join(probed, "run_id", "left").select("run_id", "files", "bytes", F.coalesce("probes", F.lit(0).cast("long")).alias("probes")))


@register(
    "export_read_back",
    W(
        f"SELECT 'depts' AS report, TRUE AS ok, {O.DEPT} AS dept, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} AND {O.DEPT} <> '' GROUP BY 3 "
        "UNION ALL SELECT 'broken', FALSE, NULL, NULL, NULL"
    ),
)
def _export_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """A batch with a failing report goes on; its status rows, joined to the CSV of the good report as read back."""
    inv = fixture_inventory(spark, sf)

    def broken() -> DataFrame:
        return duplicates.content_duplicates(inv, RUN, hash_col="no_such_column")

    with _folder(spark, "export") as base:
        status = export_reports(spark, {"broken": broken, "depts": capacity.dept_breakdown(inv, RUN)}, base)
        rows = read_report_csv(spark, f"{base}/depts", "dept string, files long, bytes long, bytes_human string").select(F.lit("depts").alias("report"), "dept", "files", "bytes")
        return _settled(status.select("report", "ok").join(rows, "report", "left").select("report", "ok", "dept", "files", "bytes"))
