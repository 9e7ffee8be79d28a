"""Structured Streaming monitors for inventories and probe loads still arriving.

* M1 ``monitor_inventory``: running totals of an inventory folder being
  written (rows, runs, newest modification, total size).
* M2 ``monitor_probes``: probe progress per run against expected counts.
* M3 ``load_probe_stream``: append-only load of probe result text files
  into the allocation table with a restartable checkpoint.

Late or repeated probe rows need no watermark: the allocation table is
append-only and every report reads it through the latest-probe view.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from invlens.functions.scalars import human_size
from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS
from invlens.session import checkpoint_dir
from invlens.sources.probes import parse_probe_results, probe_result_rejects


def _checkpoint(spark: SparkSession, name: str, location: str | None) -> str:
    return location or f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def inventory_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Inventory Parquet files as a stream (fixed schema, ``run_id=`` folders allowed)."""
    r = spark.readStream.schema(SCAN_RESULTS).option("basePath", path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def monitor_inventory(stream: DataFrame) -> DataFrame:
    """Running totals per run: rows, newest ``modified``, total size. :func:`inventory_totals` adds the runs up."""
    return stream.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("modified").alias("newest_modified"),
        F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"),
    )


def inventory_totals(per_run: DataFrame) -> DataFrame:
    """The monitor's rows as one: rows, runs (exact), newest ``modified`` as text, total size."""
    return per_run.agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"),
        F.count("run_id").alias("runs"),
        F.date_format(F.max("newest_modified"), "yyyy-MM-dd HH:mm:ss.SSS").alias("newest_modified"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("_bytes"),
    ).select("rows", "runs", "newest_modified", human_size("_bytes").alias("total_bytes"))


def monitor_probes(stream: DataFrame) -> DataFrame:
    """Per run: probe rows, first and last probe time. A file probed again counts again."""
    return stream.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("probed"), F.min("probed_at").alias("started"), F.max("probed_at").alias("latest")
    )


def probe_completion(phys: DataFrame, expected: Mapping[str, int] | int) -> DataFrame:
    """Per run of the loaded table: distinct files probed, and progress against ``expected``.

    ``expected`` is the number of files per run (a mapping) or one number
    for every run; ``done`` turns true once that many different files have a
    probe. Re-probes of a file don't count. ``phys`` may also be a stream of the
    allocation table.
    """
    if phys.isStreaming:
        g = distinct_probes(phys)
    else:
        g = phys.select("run_id", "file_uri").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("files_probed"))
    if isinstance(expected, Mapping):
        lookup = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(int(v)))])
        exp = F.try_element_at(lookup, F.col("run_id")) if expected else F.lit(None)
    else:
        exp = F.lit(int(expected))
    return (
        g.withColumn("expected", exp.cast("long"))
        .withColumn("pct_done", F.try_divide(F.lit(100.0) * F.col("files_probed"), F.col("expected")))
        .withColumn("done", F.col("files_probed") >= F.col("expected"))
    )


def distinct_probes(stream: DataFrame) -> DataFrame:
    """Per run of a streamed allocation table: different files probed, exact over restarts.

    The keys seen are the query's state, kept in its checkpoint, so a file probed
    again, in the same load or after a restart, does not count again. State grows with
    the files of the runs watched, not with the probes; give a monitor its runs by a filter on ``run_id``.
    """
    return stream.select("run_id", "file_uri").dropDuplicates(["run_id", "file_uri"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("files_probed"))


def with_progress(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """``files_probed`` per run against ``expected (run_id, expected)``, runs without a probe included."""
    g = expected.join(counts, "run_id", "left").select("run_id", F.coalesce("files_probed", F.lit(0).cast("long")).alias("files_probed"), "expected")
    return g.withColumn("pct_done", F.try_divide(F.lit(100.0) * F.col("files_probed"), F.col("expected"))).withColumn("done", F.col("files_probed") >= F.col("expected"))


def start_monitor(
    agg: DataFrame,
    query_name: str,
    checkpoint: str | None = None,
    sink: str = "memory",
    processing_time: str | None = "5 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Start a complete-mode monitor query (memory or console sink)."""
    spark = agg.sparkSession
    w = agg.writeStream.outputMode("complete").format(sink).queryName(query_name)
    w = w.option("checkpointLocation", _checkpoint(spark, f"monitor-{query_name}", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _land(spark: SparkSession, staged: str, dst: str, load_id: str) -> None:
    """Moves staged ``run_id=`` files into ``dst`` under names of this load; files of an earlier try of the load go first.

    A micro-batch is repeated as a whole after a failure, so its files are
    replaced as a whole: each load is in the table once.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root, target = path(staged), path(dst)
    fs = target.getFileSystem(conf)
    for old in fs.globStatus(path(f"{dst.rstrip('/')}/run_id=*/load-{load_id}-*")) or []:
        fs.delete(old.getPath(), False)
    if not fs.exists(root):
        return
    for folder in fs.listStatus(root):
        if folder.isDirectory() and folder.getPath().getName().startswith("run_id="):
            into = path(target, folder.getPath().getName())
            fs.mkdirs(into)
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("part-") and not fs.rename(f.getPath(), path(into, f"load-{load_id}-{name}")):
                    raise OSError(f"could not move {f.getPath()} into {into}")
    fs.delete(root, True)


def load_probe_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Append probe result files (``run_id<TAB>file_uri<TAB>allocated``) to ``dst``.

    Each micro-batch becomes plain Parquet files in the ``run_id=`` folders,
    as :func:`append_physical` writes them, so streamed and batch loads share
    one table and any reader sees both. A repeated micro-batch replaces its
    own files. When they are in place the load is entered in the ledger beside the
    table (:func:`invlens.sources.probes.read_load_ledger`). Lines that do not parse go to ``rejects`` (``<dst>_rejects`` if
    not given), one folder per load. ``probed_at`` is the load time of the
    micro-batch. Without ``checkpoint`` the folder is named by source and
    target, so that several loads can run side by side.
    """
    name = hashlib.md5(f"{src}|{dst}".encode()).hexdigest()[:16]
    where = _checkpoint(spark, f"probe-load-{name}", checkpoint)
    stream_id = hashlib.md5(where.encode()).hexdigest()[:12]
    bad = rejects or f"{dst.rstrip('/')}_rejects"

    def load(lines: DataFrame, batch: int) -> None:
        load_id = f"{stream_id}-{batch}"
        lines.persist()
        try:
            staged = f"{dst.rstrip('/')}/_loads/{load_id}"
            rows = parse_probe_results(lines).select(*[f.name for f in FILE_PHYSICAL.fields])
            rows.sortWithinPartitions("run_id", "file_uri").write.mode("overwrite").partitionBy("run_id").parquet(staged)
            session = lines.sparkSession
            counts = session.read.schema(rows.schema).parquet(staged).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("allocated").alias("allocated"))
            landed = counts.collect()  # a row per run of the load
            _land(session, staged, dst, load_id)
            rejects_of_load = probe_result_rejects(lines)
            rejects_of_load.write.mode("overwrite").parquet(f"{bad.rstrip('/')}/load={load_id}")
            entry = session.createDataFrame(landed, "run_id string, rows long, allocated long").select(
                F.lit(load_id).alias("load_id"), "run_id", "rows", "allocated", F.lit(rejects_of_load.count()).cast("long").alias("rejected"), F.localtimestamp().alias("landed_at")
            )
            entry.coalesce(1).write.mode("overwrite").parquet(f"{dst.rstrip('/')}_ledger/load={load_id}")
        finally:
            lines.unpersist()

    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    w = r.load(src).writeStream.foreachBatch(load).option("checkpointLocation", where)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
