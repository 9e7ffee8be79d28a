"""A summary table per run, from which the additive reports roll up without reading the inventory again.

``summarize`` reads a run once: its rows are grouped by several sets of
columns at a time (grouping sets), so every report's own grain is in the
table with exact counts and sums, beside nothing that grows with the files. Ages
are counted against one ``as_of``, kept in the table. A run's summary is
written once (``add_run_summary``) and other runs stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.functions.classifiers import (
    ACCESS_AGE_BANDS,
    ACCESS_AGE_REST,
    LOG_SIZE_BUCKETS,
    LOG_SIZE_REST,
    SIZE_BANDS,
    SIZE_BANDS_REST,
    age_band,
    chargeback_group,
    owner_class,
    size_band,
)
from invlens.functions.predicates import has_flag, is_orphan, is_service_account, stale
from invlens.functions.scalars import dept, human_size, path_depth, path_prefix, pct
from invlens.functions.timeutil import as_of_literal
from invlens.operators.aggregates import after_groups, quantiles_of_histogram, top_k, with_share
from invlens.plans.common import count_if, desc_then, for_run, n_rows, sum_if
from invlens.plans.size import DEPTH_QUANTILES

#: The grains of the table. Each is one grouping set; ``kind`` names it in every row.
GRAINS = {
    "dept_year": ("dept", "year"),
    "owner": ("owner_name", "owner_sid"),
    "extension": ("extension",),
    "flags": ("acl_analysis",),
    "size": ("size_bucket", "size_band"),
    "access": ("access_band",),
    "directory": ("directory",),
    "depth": ("depth",),
}
KEYS = tuple(k for keys in GRAINS.values() for k in keys)
MEASURES = ("files", "bytes", "min_size", "oldest_modified", "newest_modified", "unused_1y", "unused_3y", "unused_5y", "broken_files", "broken_bytes")
#: Path parts of ``directory``, as the report of broken inheritance groups them.
DIRECTORY_PARTS = 6


def _grain_of(grouping_id: Column) -> Column:
    """``kind`` from the grouping id, in which a bit is set for each key that the row's grain leaves out."""
    out = F.lit(None).cast("string")
    for name, keys in GRAINS.items():
        left_out = sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
        out = F.when(grouping_id == left_out, F.lit(name)).otherwise(out)
    return out


def summarize(inv: DataFrame, run_id: str, as_of) -> DataFrame:
    """``(run_id, kind, as_of, *KEYS, *MEASURES)`` of one run in one scan; keys outside a row's grain are NULL."""
    rows = for_run(inv, run_id).select(
        dept().alias("dept"),
        F.year("created").alias("year"),
        "owner_name",
        "owner_sid",
        "extension",
        "acl_analysis",
        size_band(LOG_SIZE_BUCKETS, LOG_SIZE_REST).alias("size_bucket"),
        size_band(SIZE_BANDS, SIZE_BANDS_REST).alias("size_band"),
        age_band("last_accessed", ACCESS_AGE_BANDS, ACCESS_AGE_REST, as_of).alias("access_band"),
        path_prefix(DIRECTORY_PARTS).alias("directory"),
        F.when(F.col("file_path") != "", path_depth()).alias("depth"),
        "size",
        "modified",
        *[stale("last_accessed", y, as_of).alias(f"_unused_{y}y") for y in (1, 3, 5)],
        has_flag("B").alias("_broken"),
    )
    g = rows.groupingSets([list(keys) for keys in GRAINS.values()], *KEYS).agg(
        _grain_of(F.grouping_id()).alias("kind"),
        n_rows().alias("files"),
        F.sum("size").alias("bytes"),
        F.min("size").alias("min_size"),
        F.min("modified").alias("oldest_modified"),
        F.max("modified").alias("newest_modified"),
        *[count_if(F.col(f"_unused_{y}y")).alias(f"unused_{y}y") for y in (1, 3, 5)],
        count_if(F.col("_broken")).alias("broken_files"),
        sum_if(F.col("_broken")).alias("broken_bytes"),
    )
    return g.select(F.lit(run_id).alias("run_id"), "kind", as_of_literal(as_of).alias("as_of"), *KEYS, *MEASURES)


def add_run_summary(inv: DataFrame, run_id: str, as_of, path: str) -> DataFrame:
    """Writes the run's summary to the table at ``path`` (only this run is replaced there) and returns it as read back."""
    summary = summarize(inv, run_id, as_of)
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "kind").parquet(path)
    return read_summary(inv.sparkSession, path, run_id)


def read_summary(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return for_run(df, run_id)


def _grain(summary: DataFrame, kind: str) -> DataFrame:
    return summary.where(F.col("kind") == kind)


def _files_bytes() -> list[Column]:
    return [F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("bytes")]


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("long"))


def _files_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("files"))), F.lit(0).cast("long"))


def overview(s: DataFrame) -> DataFrame:
    """R1. Each part comes from the grain that has it; the one-row parts are joined by scalar subqueries."""
    unused = _grain(s, "dept_year").agg(_total("unused_3y")).scalar()
    flags = _grain(s, "flags").agg(F.struct(_files_if(has_flag("W")).alias("w"), _files_if(has_flag("B")).alias("b"))).scalar()
    g = _grain(s, "owner").agg(
        _total("files").alias("files"), _total("bytes").alias("logical_bytes"), F.count_distinct("owner_sid").alias("unique_owners"), _files_if(is_orphan()).alias("_orphan")
    )
    g = g.select("*", unused.alias("_unused"), flags.alias("_flags"))
    return g.select(
        "files",
        "logical_bytes",
        human_size("logical_bytes").alias("logical_human"),
        "unique_owners",
        pct("_unused", "files").alias("pct_dormant_3y"),
        pct("_orphan", "files").alias("pct_orphan"),
        pct(F.col("_flags.w"), F.col("files")).alias("pct_widens_access"),
        pct(F.col("_flags.b"), F.col("files")).alias("pct_broken_inherit"),
    )


def dept_breakdown(s: DataFrame) -> DataFrame:
    """R3."""
    g = with_share(_grain(s, "dept_year").groupBy("dept").agg(*_files_bytes()), "bytes", "pct_bytes").where(after_groups(F.col("dept") != "", "files"))
    return g.select("dept", "files", "bytes", human_size("bytes").alias("bytes_human"), "pct_bytes").orderBy(*desc_then("bytes"), "dept")


def year_histogram(s: DataFrame, lo: int = 2015, hi: int = 2027) -> DataFrame:
    """R4 with the share of all files."""
    g = with_share(_grain(s, "dept_year").groupBy("year").agg(*_files_bytes()), "files", "pct_files")
    return g.where(after_groups(F.col("year").between(lo, hi), "files")).orderBy("year")


def acl_flag_distribution(s: DataFrame, limit: int = 50) -> DataFrame:
    """R10 with shares."""
    g = _grain(s, "flags").groupBy("acl_analysis").agg(_total("files").alias("files"))
    return top_k(with_share(g, "files", "pct"), desc_then("files"), limit, ["acl_analysis"])


def ownership_split(s: DataFrame) -> DataFrame:
    """R7 with shares."""
    g = _grain(s, "owner").groupBy(owner_class().alias("bucket")).agg(*_files_bytes())
    return with_share(g, "files", "pct_files", bounded=True).orderBy(*desc_then("files"), "bucket")


def extensions(s: DataFrame, order_by: str = "bytes", limit: int = 25, human: bool = True) -> DataFrame:
    """R15, R16."""
    g = _grain(s, "extension").groupBy("extension").agg(*_files_bytes())
    g = g.withColumn("bytes_human", human_size("bytes")) if human else g
    return top_k(g, desc_then(order_by), limit, ["extension"])


def size_buckets(s: DataFrame) -> DataFrame:
    """R17."""
    g = _grain(s, "size").groupBy(F.col("size_bucket").alias("bucket")).agg(*_files_bytes(), F.min("min_size").alias("_min"))
    return g.withColumn("bytes_human", human_size("bytes")).orderBy("_min").select("bucket", "files", "bytes", "bytes_human")


def size_bands(s: DataFrame) -> DataFrame:
    """R24."""
    g = _grain(s, "size").groupBy("size_band").agg(*_files_bytes())
    return g.withColumn("bytes_human", human_size("bytes")).orderBy("size_band")


def dormancy_by_dept(s: DataFrame, min_files: int = 1000) -> DataFrame:
    """R8."""
    rows = _grain(s, "dept_year").where(F.col("dept") != "")
    g = rows.groupBy("dept").agg(*[_total(f"unused_{y}y").alias(f"_a{y}") for y in (1, 3, 5)], _total("files").alias("files"))
    shares = [pct(f"_a{y}", "files", 1).alias(name) for y, name in ((1, "pct_aging_1y"), (3, "pct_dormant_3y"), (5, "pct_ancient_5y"))]
    return g.where(F.col("files") > min_files).select("dept", *shares, "files").orderBy(*desc_then("files"), "dept")


def orphan_sids(s: DataFrame, limit: int = 25) -> DataFrame:
    """R12 without the touch dates."""
    g = _grain(s, "owner").where(is_orphan()).groupBy("owner_sid").agg(F.min("owner_name").alias("sample_name"), *_files_bytes())
    return top_k(g, desc_then("files"), limit, ["owner_sid"])


def service_accounts(s: DataFrame) -> DataFrame:
    """R14."""
    g = _grain(s, "owner").where(is_service_account()).groupBy("owner_name").agg(*_files_bytes())
    return g.withColumn("bytes_human", human_size("bytes")).orderBy(*desc_then("files"), "owner_name")


def chargeback(s: DataFrame) -> DataFrame:
    """R5."""
    g = _grain(s, "owner").groupBy(chargeback_group().alias("chargeback_group")).agg(*_files_bytes())
    return g.withColumn("bytes_human", human_size("bytes")).orderBy(*desc_then("bytes"), "chargeback_group")


def age_bands(s: DataFrame) -> DataFrame:
    """R19, against the table's ``as_of``."""
    g = _grain(s, "access").groupBy(F.col("access_band").alias("band")).agg(*_files_bytes()).withColumn("bytes_human", human_size("bytes"))
    return with_share(with_share(g, "files", "pct_files", bounded=True), "bytes", "pct_bytes", bounded=True).orderBy("band")


def top_dirs_broken_inheritance(s: DataFrame, min_files: int = 1000, limit: int = 10) -> DataFrame:
    """R20."""
    g = _grain(s, "directory").groupBy("directory").agg(_total("broken_files").alias("broken_files"), _total("broken_bytes").alias("broken_bytes"))
    g = g.where(F.col("broken_files") > min_files).withColumn("broken_human", human_size("broken_bytes"))
    return top_k(g, desc_then("broken_files"), limit, ["directory"])


def tree_depth(s: DataFrame) -> DataFrame:
    """The grain is a histogram of depths."""
    hist = _grain(s, "depth").where(F.col("depth").isNotNull()).groupBy(F.col("depth").alias("v")).agg(F.sum("files").alias("c"))
    q = quantiles_of_histogram(hist, DEPTH_QUANTILES, summary=True, levels=0)
    return q.select(F.col("max").cast("int").alias("max_depth"), "p95_depth", "p50_depth")


def acl_protected(s: DataFrame) -> DataFrame:
    """R25."""
    g = _grain(s, "flags").agg(_total("files").alias("_n"), _files_if(has_flag("P")).alias("protected_dacl_files"), _files_if(has_flag("N")).alias("may_narrow_files"))
    return g.select(
        "protected_dacl_files",
        pct("protected_dacl_files", "_n").alias("pct_protected_dacl"),
        "may_narrow_files",
        pct("may_narrow_files", "_n").alias("pct_may_narrow"),
    )


def year_cohort_by_dept(s: DataFrame, year: int = 2019, limit: int = 10) -> DataFrame:
    """R26."""
    rows = _grain(s, "dept_year").where((F.col("year") == year) & (F.col("dept") != ""))
    g = rows.groupBy("dept").agg(_total("files").alias(f"files_{year}"), _total("bytes").alias(f"bytes_{year}"))
    return top_k(g.withColumn("bytes_human", human_size(f"bytes_{year}")), desc_then(f"files_{year}"), limit, ["dept"])


def summary_reports(s: DataFrame) -> dict[str, DataFrame]:
    """The standard reports that roll up from the summary ``s`` of one run, by file name."""
    return {
        "overview": overview(s),
        "dept-breakdown": dept_breakdown(s),
        "year-distribution": year_histogram(s),
        "acl-analysis-flags": acl_flag_distribution(s),
        "ownership": ownership_split(s),
        "extensions-by-bytes": extensions(s),
        "extensions-by-count": extensions(s, "files", human=False),
        "size-buckets": size_buckets(s),
        "dormancy-by-dept": dormancy_by_dept(s),
        "top-orphan-sids": orphan_sids(s),
        "service-accounts": service_accounts(s),
        "chargeback": chargeback(s),
        "age-bands-last-accessed": age_bands(s),
        "top-dirs-broken-inheritance": top_dirs_broken_inheritance(s),
        "tree-depth": tree_depth(s),
        "size-distribution-6band": size_bands(s),
        "protected-dacl": acl_protected(s),
        "year-2019-bulge": year_cohort_by_dept(s),
    }


#: Column of each report that names its rows, for :func:`rolled_up`.
REPORT_KEYS = {
    "dept-breakdown": "dept",
    "year-distribution": "year",
    "acl-analysis-flags": "acl_analysis",
    "ownership": "bucket",
    "extensions-by-bytes": "extension",
    "size-buckets": "bucket",
    "size-distribution-6band": "size_band",
    "top-orphan-sids": "owner_sid",
    "service-accounts": "owner_name",
    "chargeback": "chargeback_group",
    "age-bands-last-accessed": "band",
}


def rolled_up(s: DataFrame) -> DataFrame:
    """``(report, key, files, bytes)``: the rows of the reports that have one key, as one frame."""
    reports, out = summary_reports(s), None
    for name, key in REPORT_KEYS.items():
        df = reports[name]
        size = F.col("bytes") if "bytes" in df.columns else F.lit(None).cast("long")
        one = df.select(F.lit(name).alias("report"), F.col(key).cast("string").alias("key"), "files", size.alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out
