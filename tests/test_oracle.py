"""Every registered report against its DuckDB SQL twin on the same fixture."""

import pytest

from conftest import SF_SMALL
from invlens import catalog
from oracle_compare import compare, duck

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(catalog.oracle())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, con, catalog.oracle()[name])
    assert ok, f"{name}: {msg}"


TIME_SENSITIVE = [
    "oldest_modified",
    "oldest_modified_legacy",
    "modified_last_day",
    "age_bands",
    "daily_review",
    "cumulative_trend",
    "inventory_snapshot",
    "probe_progress",
    "ingest_facts",
]


def test_results_do_not_depend_on_session_zone_or_ansi(spark, con):
    keys = {"spark.sql.session.timeZone": "America/New_York", "spark.sql.ansi.enabled": "false"}
    saved = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for name in TIME_SENSITIVE:
            ok, msg = compare(catalog.queries()[name](spark, SF_SMALL), con, catalog.oracle()[name])
            assert ok, f"{name}: {msg}"
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
