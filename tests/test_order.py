"""Ordered reports come back, and are exported, in the reference's order with a key tie-break."""

import os
import tempfile

import pytest

from invlens import catalog
from invlens.plans import ownership
from invlens.sources.export import export_reports
from invlens.sources.fixture import DEFAULT_RUN, fixture_inventory

from conftest import SF_SMALL

DESC, ASC = True, False
ORDERS = {
    "dept_breakdown": [("bytes", DESC), ("dept", ASC)],
    "dept_breakdown_pct": [("bytes", DESC), ("dept", ASC)],
    "year_histogram": [("year", ASC)],
    "year_histogram_pct": [("year", ASC)],
    "year_histogram_files": [("year", ASC)],
    "chargeback": [("bytes", DESC), ("chargeback_group", ASC)],
    "chargeback_excl_all_employees": [("bytes", DESC), ("chargeback_group", ASC)],
    "ownership_split": [("files", DESC), ("bucket", ASC)],
    "ownership_split_pct": [("files", DESC), ("bucket", ASC)],
    "dormancy_by_dept": [("files", DESC), ("dept", ASC)],
    "acl_pattern_classifier": [("files", DESC), ("pattern", ASC)],
    "service_accounts": [("files", DESC), ("owner_name", ASC)],
    "service_accounts_bytes": [("bytes", DESC), ("owner_name", ASC)],
    "age_bands": [("band", ASC)],
    "capacity_by_age": [("age", ASC)],
    "missing_files_first20": [("file_uri", ASC)],
}


def ordered(rows, keys):
    for column, desc in reversed(keys):
        rows = sorted(rows, key=lambda r: r[column], reverse=desc)
    return rows


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_report_order(spark, name):
    rows = catalog.queries()[name](spark, SF_SMALL).collect()
    assert rows == ordered(rows, ORDERS[name])


def test_exported_files_are_in_order(spark):
    out = tempfile.mkdtemp(prefix="invlens-order-")
    report = ownership.chargeback(fixture_inventory(spark, SF_SMALL), DEFAULT_RUN)
    export_reports(spark, {"chargeback": report}, out)
    part = next(f for f in os.listdir(f"{out}/chargeback") if f.endswith(".csv"))
    with open(f"{out}/chargeback/{part}") as fh:
        names = [line.split(",")[0] for line in fh.read().splitlines()[1:]]
    assert names == [r["chargeback_group"] for r in report.collect()] and len(names) > 2
