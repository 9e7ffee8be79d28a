"""Ownership, chargeback, orphaned owners and service accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.functions.classifiers import chargeback_group, owner_class
from invlens.functions.predicates import is_orphan, is_service_account
from invlens.functions.scalars import human_size
from invlens.operators.aggregates import top_k, with_share
from invlens.plans.common import desc_then, for_run, inventory_report, n_rows, sum_or_zero


@inventory_report
def chargeback(
    inv: DataFrame,
    run_id: str | None = None,
    exclude_all_employees: bool = False,
    mode: str | None = None,
    bytes_only: bool = False,
    domain: str = "DEMO",
) -> DataFrame:
    """Bytes (and files) per chargeback group (R5; R6 with ``exclude_all_employees``)."""
    rows = for_run(inv, run_id).withColumn(
        "chargeback_group", chargeback_group(domain=domain, exclude_all_employees=exclude_all_employees, mode=mode)
    )
    if bytes_only:
        g = rows.groupBy("chargeback_group").agg(sum_or_zero("size").alias("bytes"))
        return g.orderBy(*desc_then("bytes"), "chargeback_group")
    g = rows.groupBy("chargeback_group").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    return g.withColumn("bytes_human", human_size("bytes")).orderBy(*desc_then("bytes"), "chargeback_group")


@inventory_report
def ownership_split(inv: DataFrame, run_id: str | None = None, pct: bool = False, domain: str = "DEMO") -> DataFrame:
    """Files and bytes per owner class (R7); ``pct`` adds the share of files."""
    rows = for_run(inv, run_id).withColumn("bucket", owner_class(domain=domain))
    g = rows.groupBy("bucket").agg(n_rows().alias("files"), sum_or_zero("size").alias("bytes"))
    g = with_share(g, "files", "pct_files", bounded=True) if pct else g
    return g.orderBy(*desc_then("files"), "bucket")


@inventory_report
def orphan_sids(
    inv: DataFrame,
    run_id: str | None = None,
    order_by: str = "files",
    limit: int = 25,
    touch: tuple[str, str] | None = ("oldest_touch", "newest_touch"),
    mode: str = "current",
) -> DataFrame:
    """Unresolved owner SIDs by files or bytes, with a sample name.

    The sample name is the smallest name of the SID so the result is
    deterministic. ``touch`` names the min/max ``modified`` columns, or
    leaves them out when None.
    """
    aggs = [F.min("owner_name").alias("sample_name"), n_rows().alias("files"), sum_or_zero("size").alias("bytes")]
    if touch is not None:
        aggs += [F.min("modified").alias(touch[0]), F.max("modified").alias(touch[1])]
    g = for_run(inv, run_id).where(is_orphan(mode)).groupBy("owner_sid").agg(*aggs)
    return top_k(g, desc_then(order_by), limit, ["owner_sid"])


@inventory_report
def service_accounts(
    inv: DataFrame, run_id: str | None = None, human: bool = True, folders: bool = False, domain: str = "DEMO", order_by: str = "files"
) -> DataFrame:
    """Files and bytes per service account (R14), most files or bytes first; ``folders`` adds folders touched."""
    aggs = [n_rows().alias("files"), sum_or_zero("size").alias("bytes")]
    if folders:
        aggs.append(F.count_distinct("file_path").alias("folders"))
    g = for_run(inv, run_id).where(is_service_account(domain)).groupBy("owner_name").agg(*aggs)
    g = g.withColumn("bytes_human", human_size("bytes")) if human else g
    return g.orderBy(*desc_then(order_by), "owner_name")


@inventory_report
def top_owners(inv: DataFrame, run_id: str | None = None, by: str = "bytes", limit: int = 10) -> DataFrame:
    """Owners with the most bytes (R35) or files."""
    metric = sum_or_zero("size") if by == "bytes" else n_rows()
    g = for_run(inv, run_id).groupBy("owner_name").agg(metric.alias(by))
    return top_k(g, desc_then(by), limit, ["owner_name"])
