"""Probe feed out, probe results in: the data side of the allocation walk.

The operating-system call that measures allocated bytes stays outside
Spark; these functions produce its input and load its output.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.functions.predicates import is_file
from invlens.functions.scalars import has_windows_path, windows_path
from invlens.schema import FILE_PHYSICAL, enforce_schema

TAB = "\t"
LEDGER_SCHEMA = "load_id string, run_id string, rows long, allocated long, rejected long, landed_at timestamp_ntz"
# Outcomes of a fed file: probed, no Windows path for its URI, no probe; and a probe of a file that the run doesn't have.
OUTCOME_OK = "OK"
REJECT_PATH_CONVERT = "PATH_CONVERT"
REJECT_MISSING = "MISSING"
OUTCOME_NOT_IN_RUN = "NOT_IN_RUN"


def probe_feed(inv: DataFrame, run_id: str | None = None) -> DataFrame:
    """``(run_id, file_uri)`` of file rows (directories excluded)."""
    df = inv if run_id is None else inv.where(F.col("run_id") == run_id)
    return df.where(is_file()).select("run_id", "file_uri")


def write_probe_feed(feed: DataFrame, path: str) -> None:
    """Write the feed as tab-separated text lines, no quoting, no header."""
    feed.select(F.concat_ws(TAB, "run_id", "file_uri").alias("value")).write.mode("overwrite").text(path)


def load_probe_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Parse ``run_id<TAB>file_uri`` lines; empty lines and lines without a tab are skipped."""
    lines = spark.read.text(path)
    return lines.where((F.length("value") > 0) & (F.instr("value", TAB) > 0)).select(
        F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("run_id"),
        F.expr("substring(value, instr(value, '\t') + 1)").alias("file_uri"),
    )


def _probe_parts(lines: DataFrame) -> DataFrame:
    """Lines with their parts and ``reject_reason`` (NULL when they parse); blank lines are left out."""
    v = F.col("value")
    first, from_end = F.instr(v, TAB), F.instr(F.reverse(v), TAB)
    last = F.length(v) - from_end + 1
    alloc = F.when(from_end > 0, F.substring(v, last + 1, F.length(v)).try_cast("bigint"))
    reason = (
        F.when(first == 0, F.lit("NO_TAB"))
        .when(first == last, F.lit("ONE_TAB"))
        .when(alloc.isNull(), F.lit("BAD_NUMBER"))
    )
    return lines.where(F.trim(v) != "").select(
        F.substring(v, F.lit(1), first - 1).alias("run_id"),
        F.substring(v, first + 1, last - first - 1).alias("file_uri"),
        alloc.alias("allocated"),
        reason.alias("reject_reason"),
        v.alias("original"),
    )


def parse_probe_results(lines: DataFrame, probed_at=None) -> DataFrame:
    """``run_id<TAB>file_uri<TAB>allocated`` text lines -> allocation rows.

    The first tab ends ``run_id`` and the last tab starts ``allocated``.
    Lines that do not parse come out of :func:`probe_result_rejects`.
    ``probed_at`` defaults to the load time, like the table default.
    """
    rows = _probe_parts(lines).where(F.col("reject_reason").isNull())
    return with_probed_at(rows.select("run_id", "file_uri", "allocated"), probed_at)


def probe_result_rejects(lines: DataFrame) -> DataFrame:
    """(reject_reason, original) of the lines that do not parse: NO_TAB, ONE_TAB or BAD_NUMBER."""
    return _probe_parts(lines).where(F.col("reject_reason").isNotNull()).select("reject_reason", "original")


def load_probe_results(spark: SparkSession, path: str, probed_at=None) -> DataFrame:
    return parse_probe_results(spark.read.text(path), probed_at)


def with_probed_at(df: DataFrame, probed_at=None) -> DataFrame:
    if probed_at is None:
        ts = F.localtimestamp()
    elif isinstance(probed_at, _dt.datetime):
        ts = F.lit(probed_at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    else:
        ts = F.lit(str(probed_at)).cast("timestamp_ntz")
    return df.withColumn("probed_at", ts)


def append_physical(df: DataFrame, path: str, probed_at=None) -> None:
    """Append allocation rows (``probed_at`` filled when absent), partitioned by run."""
    if "probed_at" not in df.columns:
        df = with_probed_at(df, probed_at)
    (
        enforce_schema(df, FILE_PHYSICAL)
        .sortWithinPartitions("run_id", "file_uri")
        .write.mode("append")
        .partitionBy("run_id")
        .parquet(path)
    )


def classify_probe_rows(feed: DataFrame) -> DataFrame:
    """Add ``win_path`` and ``reject_reason`` (NULL when the URI converts)."""
    return feed.withColumn("win_path", windows_path("file_uri")).withColumn(
        "reject_reason", F.when(F.col("win_path").isNull(), F.lit(REJECT_PATH_CONVERT))
    )


def split_rejects(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows whose URI converts to a Windows path, and the rest."""
    classified = classify_probe_rows(feed)
    good = classified.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = classified.where(F.col("reject_reason").isNotNull()).drop("win_path")
    return good, bad


def probe_outcomes(inv: DataFrame, phys: DataFrame, run_id: str | None = None) -> DataFrame:
    """``(run_id, file_uri, win_path, outcome)`` for every file fed and every file probed, from one full outer join.

    ``PATH_CONVERT``: the URI gives no Windows path; ``MISSING``: fed and
    convertible but without a probe; ``OK``: probed; ``NOT_IN_RUN``: a probe whose file
    the run doesn't have. Probes are made distinct map-side first.
    """
    fed = probe_feed(inv, run_id).select("run_id", "file_uri", windows_path("file_uri").alias("win_path"), F.lit(True).alias("fed"))
    probed = (phys if run_id is None else phys.where(F.col("run_id") == run_id)).select("run_id", "file_uri").distinct().withColumn("probed", F.lit(True))
    outcome = (
        F.when(F.col("fed").isNull(), OUTCOME_NOT_IN_RUN)
        .when(F.col("win_path").isNull(), REJECT_PATH_CONVERT)
        .when(F.col("probed").isNull(), REJECT_MISSING)
        .otherwise(OUTCOME_OK)
    )
    return fed.join(probed, ["run_id", "file_uri"], "full_outer").select("run_id", "file_uri", "win_path", outcome.alias("outcome"))


def write_probe_outcomes(inv: DataFrame, phys: DataFrame, path: str, run_id: str | None = None) -> None:
    """All outcomes side by side in one pass, one folder per run and outcome; other runs at ``path`` stay."""
    rows = probe_outcomes(inv, phys, run_id)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "outcome").parquet(path)


def remaining_feed(inv: DataFrame, phys: DataFrame, run_id: str | None = None) -> DataFrame:
    """``(run_id, file_uri)`` still to be probed: files with a Windows path that the allocation table doesn't hold.

    This closes the loop after a load that broke off: what landed is in the
    table, the next feed is the gap, and an empty feed means the run is done.
    """
    feed = probe_feed(inv, run_id).where(has_windows_path("file_uri"))
    return feed.join(phys.select("run_id", "file_uri").distinct(), ["run_id", "file_uri"], "left_anti")


def read_load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The load ledger beside the allocation table at ``path``: a row per landed load and run.

    ``(load_id, run_id, rows, allocated, rejected, landed_at)``; a load that was repeated is there
    once, a load that broke off before its files were in place isn't there.
    """
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path.rstrip('/')}_ledger")


def write_with_rejects(feed: DataFrame, path: str) -> None:
    """One pass: write good and rejected rows side by side, partitioned by outcome."""
    (
        classify_probe_rows(feed)
        .withColumn("outcome", F.coalesce(F.col("reject_reason"), F.lit("OK")))
        .write.mode("overwrite")
        .partitionBy("outcome")
        .parquet(path)
    )


def compact_physical(phys: DataFrame, out_path: str, run_id: str | None = None) -> None:
    """Write the latest probe per file (one row per key) to ``out_path``, partitioned by run.

    Only the runs compacted now are replaced there; other runs stay.

    The compacted copy is what a merge-on-write store keeps; reports give
    the same results on it and on the append-only original. It is written
    to a new location (a table is never overwritten while it is read).
    """
    from invlens.operators.aggregates import latest_physical

    src = phys if run_id is None else phys.where(F.col("run_id") == run_id)
    (
        enforce_schema(latest_physical(src), FILE_PHYSICAL)
        .sortWithinPartitions("run_id", "file_uri")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(out_path)
    )


def drop_run(spark: SparkSession, run_id: str, path: str | None = None, table: str | None = None) -> None:
    """Remove one run's allocation rows (catalog partition or ``run_id=`` folder); an unknown run is an error."""
    if table is not None:
        literal = run_id.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} DROP PARTITION (run_id = '{literal}')")
        return
    if path is None:
        raise ValueError("give path or table")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    part = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/run_id={folder}")
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(part):
        raise ValueError(f"no run {run_id!r} in {path}")
    fs.delete(part, True)
