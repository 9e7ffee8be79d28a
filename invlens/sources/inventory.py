"""Reading and writing the inventory and allocation tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS, enforce_schema, parse_text


TEXT_FORMATS = ("csv", "json")


def _reader(spark: SparkSession, fmt: str, schema, options: dict | None):
    r = spark.read.format(fmt)
    if fmt in ("parquet", "orc"):
        r = r.schema(schema)
    if fmt == "json":
        r = r.option("primitivesAsString", "true")
    if fmt == "csv":
        r = r.option("header", "true").option("inferSchema", "false")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r


def _load(spark: SparkSession, path: str | None, fmt: str, schema, options: dict | None) -> DataFrame:
    r = _reader(spark, fmt, schema, options)
    df = r.load(path) if path is not None else r.load()
    if fmt == "json":  # no rows, no columns: JSON names its columns in the rows
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return df


def _typed_text(raw: DataFrame, schema, bad: str) -> DataFrame:
    parsed, unreadable = parse_text(schema, raw.columns)
    rows = raw.withColumn("_unreadable", unreadable)
    if bad == "raise":
        said = F.concat(F.lit("unreadable "), F.array_join("_unreadable", ", "), F.lit(" in "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])))
        rows = rows.where(F.when(F.size("_unreadable") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    elif bad == "skip":
        rows = rows.where(F.size("_unreadable") == 0)
    elif bad != "null":
        raise ValueError(f"unknown bad {bad!r}")
    return rows.select(*[c.alias(n) for n, c in parsed.items()])


def text_rejects(spark: SparkSession, path: str, schema, format: str = "csv", options: dict | None = None) -> DataFrame:
    """Rows of a text source with a value that can't be read: ``reason`` (the columns) and ``original`` (the row as JSON)."""
    raw = _load(spark, path, format, schema, options)
    _, unreadable = parse_text(schema, raw.columns)
    named = raw.select(F.array_join(unreadable, ",").alias("reason"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("original"))
    return named.where(F.col("reason") != "")


def read_inventory(
    spark: SparkSession,
    path: str | None = None,
    run_id: str | None = None,
    format: str = "parquet",
    options: dict | None = None,
    bad: str = "raise",
) -> DataFrame:
    """Inventory rows, optionally one run only.

    Parquet tables are written partitioned by ``run_id`` (see
    :func:`write_inventory`), so the run filter prunes whole directories.
    ``format='jdbc'`` reads the exporter's table (``options`` carry url,
    dbtable, ...). ``csv``/``json`` exports are read as text and then parsed
    (see :func:`invlens.schema.parse_text`); a row with an unreadable value
    is an error (``bad='raise'``), left out (``'skip'``, to be used with
    :func:`text_rejects`, which returns those rows), or kept with NULLs
    (``'null'``). A JDBC read is one connection unless the options split it
    (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``);
    the run filter is pushed into the database query.
    """
    df = _load(spark, path, format, SCAN_RESULTS, options)
    if format in TEXT_FORMATS:
        df = _typed_text(df, SCAN_RESULTS, bad)
    else:
        df = enforce_schema(df, SCAN_RESULTS, lenient_time=format not in ("parquet", "orc"))
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def read_physical(
    spark: SparkSession, path: str, run_id: str | None = None, format: str = "parquet", options: dict | None = None, bad: str = "raise"
) -> DataFrame:
    """Allocation rows (all probes, re-probes included), optionally one run; text sources as in :func:`read_inventory`."""
    raw = _load(spark, path, format, FILE_PHYSICAL, options)
    df = _typed_text(raw, FILE_PHYSICAL, bad) if format in TEXT_FORMATS else enforce_schema(raw, FILE_PHYSICAL)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def _spread(df: DataFrame, num_files: int | None) -> DataFrame:
    """Hash-spread rows over ``num_files`` tasks (so each run gets up to that many files)."""
    return df if num_files is None else df.repartition(num_files, "run_id", "file_uri")


def write_inventory(df: DataFrame, path: str, mode: str = "append", num_files: int | None = None) -> None:
    """Write inventory rows partitioned by ``run_id``, sorted by ``file_uri`` inside files.

    Sorting inside each task (no global sort) keeps row-group min/max of
    ``file_uri`` tight for point lookups. ``num_files`` spreads each run
    over that many files so later scans split evenly across executors.
    """
    (
        _spread(enforce_schema(df, SCAN_RESULTS), num_files)
        .sortWithinPartitions("run_id", "file_uri")
        .write.mode(mode)
        .partitionBy("run_id")
        .parquet(path)
    )


def write_physical(df: DataFrame, path: str, mode: str = "append", num_files: int | None = None) -> None:
    """Append allocation rows partitioned by ``run_id``."""
    (
        _spread(enforce_schema(df, FILE_PHYSICAL), num_files)
        .sortWithinPartitions("run_id", "file_uri")
        .write.mode(mode)
        .partitionBy("run_id")
        .parquet(path)
    )


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, kind: str = "inventory") -> None:
    """Write runs into a catalog table partitioned by ``run_id`` and bucketed/sorted by ``file_uri``.

    Creates the table if there is none. Only the runs in ``df`` are
    replaced (dynamic partition overwrite); all other runs of the table stay.
    Rows are first hash-partitioned by ``file_uri`` into ``buckets`` tasks
    (the same hash as the bucket id), so each run partition gets exactly
    one file per bucket. Inventory and allocation tables written with the
    same bucket count join and aggregate on ``file_uri`` with no shuffle.
    """
    schema = SCAN_RESULTS if kind == "inventory" else FILE_PHYSICAL
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    register_bucketed(spark, table, path, buckets, kind)
    rows = enforce_schema(df, schema).repartition(buckets, "file_uri")
    order = [f.name for f in schema.fields if f.name != "run_id"] + ["run_id"]
    # ``insertInto`` takes the mode from the session alone.
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.select(*order).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").collect()
    return _plain(rows[0]["data_type"]) if rows else ""


def _plain(path: str) -> str:
    """A path without the local scheme and trailing slash, to compare locations."""
    return re.sub(r"^file:/*", "/", str(path)).rstrip("/")


def register_bucketed(spark: SparkSession, table: str, path: str, buckets: int, kind: str = "inventory") -> DataFrame:
    """Register a bucketed folder as a catalog table (new or known in this session) and return it.

    A table of that name at another location is an error.
    """
    schema = SCAN_RESULTS if kind == "inventory" else FILE_PHYSICAL
    if spark.catalog.tableExists(table):
        if _location(spark, table) != _plain(path):
            raise ValueError(f"table {table} is at {_location(spark, table)}, not at {path}")
    else:
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({_ddl(schema)}) USING parquet PARTITIONED BY (run_id) "
            f"CLUSTERED BY (file_uri) SORTED BY (file_uri) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'"
        )
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def list_runs(inv: DataFrame) -> DataFrame:
    """Run ids, newest first by the (text) ``max(run_start_time)``."""
    return inv.groupBy("run_id").agg(F.max("run_start_time").alias("run_start_time")).orderBy(
        F.col("run_start_time").desc(), F.col("run_id")
    )


def read_report_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A report CSV with header (golden snapshot or an earlier export)."""
    r = spark.read.option("header", "true")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)
