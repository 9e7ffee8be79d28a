"""Physical-plan properties the reports rely on at scale."""

import os
import re

import pytest

from conftest import SF_SMALL
from invlens.plans import acl, capacity, duplicates, overview, physical, size
from invlens.sources.fixture import AS_OF, file_physical_from_inventory, fixture_inventory
from invlens.sources.inventory import read_inventory, read_physical, write_inventory, write_physical

RUN = "run-2"


@pytest.fixture(scope="module")
def stored(spark, scratch):
    base = os.path.join(scratch, "plans")
    inv = fixture_inventory(spark, SF_SMALL)
    write_inventory(inv, f"{base}/inv", mode="overwrite", num_files=4)
    write_physical(file_physical_from_inventory(inv), f"{base}/phys", mode="overwrite", num_files=4)
    return read_inventory(spark, f"{base}/inv"), read_physical(spark, f"{base}/phys")


def executed(df) -> list:
    """Nodes of the plan as it ran, subqueries included; what a reused exchange or subquery reads is there once."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        out.append(node)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif not kind.startswith("Reused"):
            for more in (node.children(), node.subqueries()):
                todo += [more.apply(i) for i in range(more.size())]
    return out


def count(nodes, kind: str) -> int:
    return sum(n.getClass().getSimpleName().startswith(kind) for n in nodes)


def final_plan(df) -> str:
    """Executed plan after the run as text; with AQE only the final section."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_run_filter_prunes_partitions_and_one_scan(stored):
    inv, _ = stored
    plan = final_plan(overview.overview(inv, RUN, AS_OF))
    assert re.search(r"PartitionFilters: \[.*run_id.*= run-2", plan) or "PartitionFilters: [isnotnull(run_id" in plan
    assert plan.count("FileScan parquet") == 1  # every KPI in one pass
    assert "acl," not in plan.split("ReadSchema")[1].split("\n")[0]  # wide ACL text not read


def test_age_predicate_reaches_the_scan(stored):
    inv, _ = stored
    plan = final_plan(capacity.cold_folders(inv, RUN, AS_OF))
    assert "LessThan(last_accessed," in plan


def test_top_k_is_take_ordered(stored):
    inv, _ = stored
    plan = final_plan(duplicates.duplicate_clusters(inv, RUN))
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("report", [capacity.dept_breakdown, capacity.year_histogram, acl.acl_flag_distribution])
def test_shares_scan_once(stored, report):
    """The total is a subquery over the same shuffle as the groups: one scan, no window over all groups."""
    inv, _ = stored
    nodes = executed(report(inv, RUN, pct=True))
    assert count(nodes, "FileSourceScan") == 1 and count(nodes, "ReusedExchange") == 1 and count(nodes, "Window") == 0


def test_quantiles_share_the_histogram(stored):
    inv, _ = stored
    plan = final_plan(size.size_quantiles(inv, RUN))
    assert "ReusedExchange" in plan
    assert plan.count("FileScan parquet") == 1


def test_join_reuses_aggregate_partitioning(stored):
    inv, phys = stored
    plan = final_plan(physical.logical_physical_tiles(inv, phys, RUN))
    assert ("SortMergeJoin" in plan) or ("BroadcastHashJoin" in plan) or ("ShuffledHashJoin" in plan)
    # one shuffle per side on the join keys: the latest-probe aggregate feeds the join directly
    assert plan.count("hashpartitioning(run_id") <= 2


def test_bucketed_join_has_no_shuffle(spark, scratch):
    from invlens.sources.inventory import register_bucketed, write_bucketed

    inv = fixture_inventory(spark, SF_SMALL)
    base = os.path.join(scratch, "bucketed")
    write_bucketed(inv, "t_inv_b", f"{base}/inv", 4)
    write_bucketed(file_physical_from_inventory(inv), "t_phys_b", f"{base}/phys", 4, kind="physical")
    inv_b = register_bucketed(spark, "t_inv_b", f"{base}/inv", 4)
    phys_b = register_bucketed(spark, "t_phys_b", f"{base}/phys", 4, kind="physical")
    df = physical.logical_physical_tiles(inv_b, phys_b, RUN)
    plain = physical.logical_physical_tiles(fixture_inventory(spark, SF_SMALL), file_physical_from_inventory(inv), RUN)
    assert df.collect() == plain.collect()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = final_plan(physical.logical_physical_tiles(inv_b, phys_b, RUN))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan
    assert "hashpartitioning(file_uri" not in plan
