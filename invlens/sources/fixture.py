"""Synthetic file inventory derived from the TPC-H-like ``orders`` table.

The test data holds no file inventory, so one is derived row by row from
``orders`` (one file per order and run). The derivation is a projection plus
a union of two runs: it is distributed exactly like ``orders`` and grows with
it. ``FIXTURE_SQL`` is the same derivation as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.schema import FILE_PHYSICAL, SCAN_RESULTS, enforce_schema

# Fixed values of the fixture (FIXTURES.md §2).
AS_OF = "2024-06-01 00:00:00"
DEFAULT_RUN = "run-2"
PREVIOUS_RUN = "run-1"
RUNS = (("run-2", "2024-06-01T10:00:00", 0), ("run-1", "2024-05-01T10:00:00", 1))
DEPTS = ("IT", "Training", "Marketing", "Finance", "Support", "Sales", "Legal", "R&D", "")
EXTS = ("PDF", "DOCX", "LOG", "BAK", "XLSX", "MP4")
SUBDIRS = ("Archive/2019/", "Projects/Phoenix/", "team docs/")
FLAGS = ("", "WNEBd", "d", "WEpd", "NEPpd")
ACE = "(A;;FA;;;SY)"
ACL_HEAD = "O:BAG:DUD:AI"
BS = "\\"
INGEST_TS = "2024-06-01 10:05:00"
PROBE_TS = ("2024-06-01 12:00:00", "2024-06-01 13:00:00")
ALLOC_CAP = 131072


def _pick(key: Column, values) -> Column:
    """``CASE key WHEN 0 THEN values[0] ... END`` (last value is the default)."""
    chain = None
    for i, v in enumerate(values[:-1]):
        chain = F.when(key == i, v) if chain is None else chain.when(key == i, v)
    return chain.otherwise(values[-1])


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _s(c: Column) -> Column:
    return c.cast("string")


def scan_results_from_orders(orders: DataFrame) -> DataFrame:
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    base = orders.select(
        k.alias("k"),
        c.alias("c"),
        p.alias("p"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '21' YEAR")).alias("d"),
        _pick(c % 9, DEPTS).alias("dept"),
    )
    runs = None
    for run_id, start, bump in RUNS:
        part = base if bump == 0 else base.where(F.col("k") % 10 != 0)
        part = part.select("*", F.lit(run_id).alias("run_id"), F.lit(start).alias("run_start_time"), F.lit(bump).alias("bump"))
        runs = part if runs is None else runs.unionByName(part)

    k, c, p, d, dept, bump = (F.col(x) for x in ("k", "c", "p", "d", "dept", "bump"))
    is_dir = k % 997 == 0
    ext = _pick(k % 6, EXTS)
    path = F.when(dept == "", "/S/Shared/").otherwise(F.concat(F.lit("/S/Shared/"), dept, F.lit("/"), _pick(k % 3, SUBDIRS)))
    enc = F.replace(path, F.lit(" "), F.lit("%20"))
    k500 = _s(k % 500)
    uri = F.when(is_dir, F.concat(F.lit("win://host"), enc, F.lit("d"), _s(k), F.lit("/"))).otherwise(
        F.concat(F.lit("win://host"), enc, _s(k), F.lit("_"), k500, F.lit("."), F.lower(ext))
    )
    floor_p = F.floor(p).cast("long")
    size = (
        F.when(is_dir, F.lit(0).cast("long"))
        .when(k % 11 == 0, (k % 1000).cast("long"))
        .when(k % 11 == 1, floor_p * 20000 + bump)
        .when(k % 11 < 6, ((k % 50 + 1) * 1048576 + 1).cast("long"))
        .otherwise(floor_p * 3 + bump)
    )
    c20, c40 = c % 20, _s(c % 40)
    owner = (
        F.when(c20 == 0, F.concat(F.lit("S-1-5-21-1-2-3-"), c40))
        .when(c20 == 1, "")
        .when(c20 == 2, f"DEMO{BS}svc_backup")
        .when(c20 == 3, f"BUILTIN{BS}Administrators")
        .when(c20 == 4, F.concat(F.lit(f"DEMO{BS}user"), c40))
        .when(c20 == 5, f"DEMO{BS}GG_AllEmployees")
        .otherwise(F.concat(F.lit(f"DEMO{BS}GG_"), F.when(dept == "", "IT").otherwise(dept)))
    )
    out = runs.select(
        "run_id",
        "run_start_time",
        uri.alias("file_uri"),
        path.alias("file_path"),
        F.when(is_dir, "").otherwise(F.concat(F.lit("doc_"), k500, F.lit("."), F.lower(ext))).alias("filename"),
        F.when(is_dir, "").otherwise(ext).alias("extension"),
        size.alias("size"),
        (k % 41 == 0).alias("migrated"),
        owner.alias("owner_name"),
        F.concat(F.lit("S-1-5-21-1-2-3-"), c40).alias("owner_sid"),
        F.concat(F.lit(ACL_HEAD), F.repeat(F.lit(ACE), (k % 9).cast("int"))).alias("acl"),
        _pick(k % 10, FLAGS + ("NEBd",)).alias("acl_analysis"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(ACL_HEAD), F.repeat(F.lit(ACE), (k % 3).cast("int")))).alias("parent_acl"),
        F.when(k % 7 == 0, "Zone.Identifier").otherwise("").alias("win_ads_names"),
        d.alias("created"),
        _pick(k % 3, (d, d + F.expr("INTERVAL '120' DAY"), d + F.expr("INTERVAL '800' DAY"))).alias("modified"),
        _pick(k % 4, (d + F.expr("INTERVAL '900' DAY"), d + F.expr("INTERVAL '1500' DAY"), d + F.expr("INTERVAL '801' DAY"))).alias("last_accessed"),
        _ts(INGEST_TS).alias("ingest_created"),
        _ts(INGEST_TS).alias("ingest_modified"),
        F.when(k % 41 == 0, "ARCHIVE").otherwise("").alias("storage_class"),
        F.when(k % 41 == 0, "OFFLINE").otherwise("").alias("storage_state"),
        F.lit("").alias("version_id"),
    )
    return enforce_schema(out, SCAN_RESULTS)


def file_physical_from_inventory(inv: DataFrame) -> DataFrame:
    f = inv.where(F.col("filename") != "").select("run_id", "file_uri", "size", F.length("file_uri").alias("n"))
    kept = f.where(F.col("n") % 29 != 0)
    first = kept.select(
        "run_id",
        "file_uri",
        F.when(F.col("size") < ALLOC_CAP, F.col("size")).otherwise(F.lit(ALLOC_CAP).cast("long")).alias("allocated"),
        _ts(PROBE_TS[0]).alias("probed_at"),
    )
    again = kept.where(F.col("size") % 13 == 0).select(
        "run_id", "file_uri", F.lit(4096).cast("long").alias("allocated"), _ts(PROBE_TS[1]).alias("probed_at")
    )
    return enforce_schema(first.unionByName(again), FILE_PHYSICAL)


def varied_inventory(inv: DataFrame) -> DataFrame:
    """``inv`` with the values that the plain derivation lacks.

    ACLs that name Everyone, shares, groups, DENY and SIDs; unresolved owners
    and several service accounts; a second host, URIs without a Windows path, non-ASCII names;
    paths that end in a file name; the flag Z.
    """
    n, uri, owner, acl = F.col("size"), F.col("file_uri"), F.col("owner_name"), F.col("acl")
    ace = F.when(n % 7 == 1, "(A;;FA;;;Everyone)").when(n % 7 == 2, f"(A;;FA;;;DEMO{BS}DL_Share_RW)").when(n % 7 == 3, "(DENY;;FA;;;BU)")
    ace = ace.when(n % 7 == 4, "(A;;FA;;;S-1-5-21-9)").when(n % 7 == 5, f"(A;;FA;;;DEMO{BS}GG_IT)").otherwise("")
    service = F.concat(F.lit(f"DEMO{BS}svc_"), _pick(n % 3, ("backup", "scan", "etl")))
    return inv.withColumns(
        {
            "acl": F.concat(acl, ace),
            "owner_name": F.when((owner == "") & (n % 2 == 1), "Unresolved account").when(owner == f"DEMO{BS}svc_backup", service).otherwise(owner),
            "file_uri": F.when(n % 5 == 2, F.replace(uri, F.lit("win://host/"), F.lit("win://host2/")))
            .when(n % 37 == 3, F.replace(uri, F.lit("win://"), F.lit("nfs://")))
            .when(n % 11 == 5, F.concat(uri, F.lit("é")))
            .otherwise(uri),
            "file_path": F.when(n % 3 == 1, F.concat("file_path", F.lit("x"))).otherwise(F.col("file_path")),
            "acl_analysis": F.when(n % 13 == 4, F.concat("acl_analysis", F.lit("Z"))).otherwise(F.col("acl_analysis")),
        }
    )


def varied_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The varied inventory and its probes, with probes of files that no run has."""
    inv = varied_inventory(fixture_inventory(spark, sf_dir))
    phys = file_physical_from_inventory(inv)
    gone = phys.where(F.col("allocated") % 17 == 3).withColumn("file_uri", F.concat("file_uri", F.lit(".gone")))
    return inv, phys.unionByName(gone)


def load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")


def fixture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_results_from_orders(load_orders(spark, sf_dir))


def fixture_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inv = fixture_inventory(spark, sf_dir)
    return inv, file_physical_from_inventory(inv)


# The same derivation as SQL (FIXTURES.md §2), used as the oracle's input.
FIXTURE_SQL = r"""
scan_results AS (
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderdate + INTERVAL '21' YEAR AS d,
    CASE o_custkey % 9 WHEN 0 THEN 'IT' WHEN 1 THEN 'Training' WHEN 2 THEN 'Marketing' WHEN 3 THEN 'Finance'
      WHEN 4 THEN 'Support' WHEN 5 THEN 'Sales' WHEN 6 THEN 'Legal' WHEN 7 THEN 'R&D' ELSE '' END AS dept
  FROM orders),
runs AS (
  SELECT base.*, 'run-2' AS run_id, '2024-06-01T10:00:00' AS run_start_time, 0 AS bump FROM base
  UNION ALL
  SELECT base.*, 'run-1', '2024-05-01T10:00:00', 1 FROM base WHERE k % 10 <> 0),
shaped AS (
  SELECT runs.*,
    (k % 997 = 0) AS is_dir,
    CASE k % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'LOG' WHEN 3 THEN 'BAK' WHEN 4 THEN 'XLSX' ELSE 'MP4' END AS ext,
    CASE WHEN dept = '' THEN '/S/Shared/'
      ELSE '/S/Shared/' || dept || '/' || CASE k % 3 WHEN 0 THEN 'Archive/2019/' WHEN 1 THEN 'Projects/Phoenix/' ELSE 'team docs/' END END AS path
  FROM runs)
SELECT run_id, run_start_time,
  CASE WHEN is_dir THEN 'win://host' || replace(path, ' ', '%20') || 'd' || CAST(k AS VARCHAR(20)) || '/'
    ELSE 'win://host' || replace(path, ' ', '%20') || CAST(k AS VARCHAR(20)) || '_' || CAST(k % 500 AS VARCHAR(20)) || '.' || lower(ext) END AS file_uri,
  path AS file_path,
  CASE WHEN is_dir THEN '' ELSE 'doc_' || CAST(k % 500 AS VARCHAR(20)) || '.' || lower(ext) END AS filename,
  CASE WHEN is_dir THEN '' ELSE ext END AS extension,
  CASE WHEN is_dir THEN CAST(0 AS BIGINT)
    WHEN k % 11 = 0 THEN CAST(k % 1000 AS BIGINT)
    WHEN k % 11 = 1 THEN CAST(floor(p) AS BIGINT) * 20000 + bump
    WHEN k % 11 < 6 THEN CAST((k % 50 + 1) * 1048576 + 1 AS BIGINT)
    ELSE CAST(floor(p) AS BIGINT) * 3 + bump END AS size,
  (k % 41 = 0) AS migrated,
  CASE c % 20 WHEN 0 THEN 'S-1-5-21-1-2-3-' || CAST(c % 40 AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN 'DEMO' || chr(92) || 'svc_backup'
    WHEN 3 THEN 'BUILTIN' || chr(92) || 'Administrators' WHEN 4 THEN 'DEMO' || chr(92) || 'user' || CAST(c % 40 AS VARCHAR(20))
    WHEN 5 THEN 'DEMO' || chr(92) || 'GG_AllEmployees'
    ELSE 'DEMO' || chr(92) || 'GG_' || CASE WHEN dept = '' THEN 'IT' ELSE dept END END AS owner_name,
  'S-1-5-21-1-2-3-' || CAST(c % 40 AS VARCHAR(20)) AS owner_sid,
  'O:BAG:DUD:AI' || repeat('(A;;FA;;;SY)', CAST(k % 9 AS INT)) AS acl,
  CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN 'WNEBd' WHEN 2 THEN 'd' WHEN 3 THEN 'WEpd' WHEN 4 THEN 'NEPpd' ELSE 'NEBd' END AS acl_analysis,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'O:BAG:DUD:AI' || repeat('(A;;FA;;;SY)', CAST(k % 3 AS INT)) END AS parent_acl,
  CASE WHEN k % 7 = 0 THEN 'Zone.Identifier' ELSE '' END AS win_ads_names,
  d AS created,
  CASE k % 3 WHEN 0 THEN d WHEN 1 THEN d + INTERVAL '120' DAY ELSE d + INTERVAL '800' DAY END AS modified,
  CASE k % 4 WHEN 0 THEN d + INTERVAL '900' DAY WHEN 1 THEN d + INTERVAL '1500' DAY ELSE d + INTERVAL '801' DAY END AS last_accessed,
  TIMESTAMP '2024-06-01 10:05:00' AS ingest_created, TIMESTAMP '2024-06-01 10:05:00' AS ingest_modified,
  CASE WHEN k % 41 = 0 THEN 'ARCHIVE' ELSE '' END AS storage_class, CASE WHEN k % 41 = 0 THEN 'OFFLINE' ELSE '' END AS storage_state,
  '' AS version_id
FROM shaped),
file_physical AS (
WITH f AS (SELECT run_id, file_uri, size, length(file_uri) AS n FROM scan_results WHERE filename <> '')
SELECT run_id, file_uri, CASE WHEN size < 131072 THEN size ELSE CAST(131072 AS BIGINT) END AS allocated, TIMESTAMP '2024-06-01 12:00:00' AS probed_at FROM f WHERE n % 29 <> 0
UNION ALL
SELECT run_id, file_uri, CAST(4096 AS BIGINT), TIMESTAMP '2024-06-01 13:00:00' FROM f WHERE n % 29 <> 0 AND size % 13 = 0)
"""

# The varied inventory and its probes as SQL, on top of FIXTURE_SQL.
VARIED_SQL = r"""
varied AS (
SELECT * REPLACE (
  acl || CASE size % 7 WHEN 1 THEN '(A;;FA;;;Everyone)' WHEN 2 THEN '(A;;FA;;;DEMO' || chr(92) || 'DL_Share_RW)' WHEN 3 THEN '(DENY;;FA;;;BU)'
    WHEN 4 THEN '(A;;FA;;;S-1-5-21-9)' WHEN 5 THEN '(A;;FA;;;DEMO' || chr(92) || 'GG_IT)' ELSE '' END AS acl,
  CASE WHEN owner_name = '' AND size % 2 = 1 THEN 'Unresolved account'
    WHEN owner_name = 'DEMO' || chr(92) || 'svc_backup' THEN 'DEMO' || chr(92) || 'svc_' || CASE size % 3 WHEN 0 THEN 'backup' WHEN 1 THEN 'scan' ELSE 'etl' END
    ELSE owner_name END AS owner_name,
  CASE WHEN size % 5 = 2 THEN replace(file_uri, 'win://host/', 'win://host2/') WHEN size % 37 = 3 THEN replace(file_uri, 'win://', 'nfs://')
    WHEN size % 11 = 5 THEN file_uri || 'é' ELSE file_uri END AS file_uri,
  CASE WHEN size % 3 = 1 THEN file_path || 'x' ELSE file_path END AS file_path,
  CASE WHEN size % 13 = 4 THEN acl_analysis || 'Z' ELSE acl_analysis END AS acl_analysis)
FROM scan_results),
varied_physical AS (
WITH f AS (SELECT run_id, file_uri, size, length(file_uri) AS n FROM varied WHERE filename <> ''),
p AS (SELECT run_id, file_uri, CASE WHEN size < 131072 THEN size ELSE CAST(131072 AS BIGINT) END AS allocated, TIMESTAMP '2024-06-01 12:00:00' AS probed_at FROM f WHERE n % 29 <> 0
  UNION ALL SELECT run_id, file_uri, CAST(4096 AS BIGINT), TIMESTAMP '2024-06-01 13:00:00' FROM f WHERE n % 29 <> 0 AND size % 13 = 0)
SELECT * FROM p UNION ALL SELECT run_id, file_uri || '.gone', allocated, probed_at FROM p WHERE allocated % 17 = 3)
"""
