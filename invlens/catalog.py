"""Registry of reports run on the derived test inventory.

Each entry is ``name -> (spark, sf_dir) -> DataFrame`` plus, where the
report is expressible in SQL, an independent DuckDB query over the same
fixture. Every entry reads ``orders`` of the given scale and derives the
inventory from it, so its work grows with the data. The derivation shapes
rows with modulo arithmetic (which orders the earlier run has, which files
lack a probe; see FIXTURES.md); no report leaves rows of its tables out, and
the only limits are the reports' own top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens import oracle_sql as O
from invlens.operators.joins import capacity as capacity_of_files
from invlens.operators.joins import missing_probes, orphan_probes
from invlens.plans import acl, age, capacity, cost, directory, duplicates, overview, ownership, physical, runs, size
from invlens.sources import probes
from invlens.sources.fixture import (
    AS_OF,
    DEFAULT_RUN,
    PREVIOUS_RUN,
    PROBE_TS,
    file_physical_from_inventory,
    fixture_inventory,
    fixture_tables,
    scan_results_from_orders,
)

RUN = DEFAULT_RUN
W = O.with_fixture
R = O.RUN


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: list[Entry] = []


def register(name: str, sql: str | None):
    def deco(fn):
        ENTRIES.append(Entry(name, fn, sql))
        return fn

    return deco


def inv_report(name: str, sql: str | None, fn, /, **kw):
    """Register ``fn(inv, **kw)`` over the derived inventory."""
    register(name, sql)(lambda spark, sf: fn(fixture_inventory(spark, sf), **kw))


def phys_report(name: str, sql: str | None, fn, /, with_inv: bool = True, **kw):
    """Register ``fn(inv, phys, **kw)`` (or ``fn(phys, **kw)``) over the derived tables."""

    def build(spark, sf):
        inv, phys = fixture_tables(spark, sf)
        return fn(inv, phys, **kw) if with_inv else fn(phys, **kw)

    register(name, sql)(build)


H, P, S0, SI = O.human, O.pct, O.sum0, O.sum_if

# ---------------------------------------------------------------- overview
inv_report(
    "overview",
    W(
        f"SELECT count(*) AS files, {S0('size')} AS logical_bytes, {H(S0('size'))} AS logical_human, "
        f"count(DISTINCT owner_sid) AS unique_owners, "
        f"{P(f'count_if({O.stale('last_accessed', 3)})', 'count(*)')} AS pct_dormant_3y, "
        f"{P(f'count_if({O.ORPHAN})', 'count(*)')} AS pct_orphan, "
        f"{P(f'count_if({O.flag('W')})', 'count(*)')} AS pct_widens_access, "
        f"{P(f'count_if({O.flag('B')})', 'count(*)')} AS pct_broken_inherit "
        f"FROM scan_results WHERE {R}"
    ),
    overview.overview,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report("total_files", W(f"SELECT count(*) AS files FROM scan_results WHERE {R}"), overview.total_files, run_id=RUN)
inv_report("total_bytes", W(f"SELECT {S0('size')} AS bytes FROM scan_results WHERE {R}"), overview.total_bytes, run_id=RUN)
inv_report(
    "unique_owners", W(f"SELECT count(DISTINCT owner_sid) AS owners FROM scan_results WHERE {R}"), overview.unique_owners, run_id=RUN
)
inv_report(
    "oldest_modified",
    W(f"SELECT epoch_ms(min(modified)) AS oldest FROM scan_results WHERE {R}"),
    overview.oldest_modified,
    run_id=RUN,
)
inv_report(
    "oldest_modified_legacy",
    W(f"SELECT min(modified) AS oldest FROM scan_results WHERE {R}"),
    overview.oldest_modified,
    run_id=RUN,
    epoch=False,
)
inv_report(
    "pct_orphan_files",
    W(f"SELECT {P(f'count_if({O.ORPHAN})', 'count(*)', None)} AS pct FROM scan_results WHERE {R}"),
    overview.pct_orphan_files,
    run_id=RUN,
)
inv_report(
    "pct_orphan_status",
    W(
        f"SELECT pct, CASE WHEN pct >= 5 THEN 'red' WHEN pct >= 1 THEN 'orange' ELSE 'green' END AS status FROM "
        f"(SELECT {P(f'count_if({O.ORPHAN})', 'count(*)', None)} AS pct FROM scan_results WHERE {R})"
    ),
    overview.pct_orphan_files,
    run_id=RUN,
    with_status=True,
)
inv_report(
    "pct_widens_files",
    W(f"SELECT {P(f'count_if({O.flag('W')})', 'count(*)', None)} AS pct FROM scan_results WHERE {R}"),
    overview.pct_flag_files,
    run_id=RUN,
    letter="W",
)
inv_report(
    "pct_broken_files",
    W(f"SELECT {P(f'count_if({O.flag('B')})', 'count(*)', None)} AS pct FROM scan_results WHERE {R}"),
    overview.pct_flag_files,
    run_id=RUN,
    letter="B",
)
inv_report(
    "orphan_count", W(f"SELECT count_if({O.ORPHAN}) AS orphans FROM scan_results WHERE {R}"), overview.orphan_count, run_id=RUN
)
inv_report(
    "widens_count",
    W(f"SELECT count_if({O.flag('W')}) AS widens FROM scan_results WHERE {R}"),
    overview.flag_count,
    run_id=RUN,
    letter="W",
    name="widens",
)
inv_report(
    "broken_count",
    W(f"SELECT count_if({O.flag('B')}) AS broken FROM scan_results WHERE {R}"),
    overview.flag_count,
    run_id=RUN,
    letter="B",
    name="broken",
)
inv_report(
    "modified_last_day",
    W(f"SELECT count_if(modified > {O.ago(1, 'DAY')}) AS active FROM scan_results WHERE {R}"),
    overview.modified_recently,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "orphan_bytes", W(f"SELECT {SI(O.ORPHAN)} AS bytes FROM scan_results WHERE {R}"), overview.orphan_bytes, run_id=RUN
)
inv_report(
    "acl_protected",
    W(
        f"SELECT count_if({O.flag('P')}) AS protected_dacl_files, "
        f"{P(f'count_if({O.flag('P')})', 'count(*)')} AS pct_protected_dacl, "
        f"count_if({O.flag('N')}) AS may_narrow_files, "
        f"{P(f'count_if({O.flag('N')})', 'count(*)')} AS pct_may_narrow FROM scan_results WHERE {R}"
    ),
    overview.acl_protected,
    run_id=RUN,
)
inv_report(
    "acl_protected_case_sensitive",
    W(
        f"SELECT count_if(contains(acl_analysis, 'P')) AS protected_dacl_files, "
        f"{P('count_if(contains(acl_analysis, ' + chr(39) + 'P' + chr(39) + '))', 'count(*)')} AS pct_protected_dacl, "
        f"count_if(contains(acl_analysis, 'N')) AS may_narrow_files, "
        f"{P('count_if(contains(acl_analysis, ' + chr(39) + 'N' + chr(39) + '))', 'count(*)')} AS pct_may_narrow "
        f"FROM scan_results WHERE {R}"
    ),
    overview.acl_protected,
    run_id=RUN,
    case_sensitive=True,
)
inv_report(
    "ingest_facts",
    W(
        f"SELECT count(*) AS rows, count_if({O.IS_FILE}) AS files, count_if({O.IS_DIR}) AS dirs, "
        f"CAST(max(length(file_uri)) AS INTEGER) AS max_uri_length, count_if(regexp_matches(file_uri, '[^\\x00-\\x7F]')) AS non_ascii_uris, "
        f"count_if(regexp_matches(file_uri, '%[0-9A-Fa-f]{{2}}')) AS encoded_uris, "
        f"min(modified) AS min_modified, max(modified) AS max_modified FROM scan_results WHERE {R}"
    ),
    overview.ingest_facts,
    run_id=RUN,
)
# legacy tiles (older dashboard definitions)
inv_report(
    "legacy_orphan_count",
    W(f"SELECT count_if({O.ORPHAN_LEGACY}) AS orphans FROM scan_results WHERE {R}"),
    overview.orphan_count,
    run_id=RUN,
    mode="legacy",
)
inv_report(
    "legacy_orphan_pct",
    W(f"SELECT {P(f'count_if({O.ORPHAN_LEGACY})', 'count(*)', None)} AS pct FROM scan_results WHERE {R}"),
    overview.pct_orphan_files,
    run_id=RUN,
    mode="legacy",
)
inv_report(
    "legacy_orphan_bytes",
    W(f"SELECT {SI(O.ORPHAN_LEGACY)} AS bytes FROM scan_results WHERE {R}"),
    overview.orphan_bytes,
    run_id=RUN,
    mode="legacy",
)
inv_report(
    "legacy_everyone_pct",
    W(f"SELECT {P(f'count_if({O.mentions('Everyone')})', 'count(*)', None)} AS pct FROM scan_results WHERE {R}"),
    overview.pct_everyone_files,
    run_id=RUN,
)
inv_report(
    "legacy_everyone_count",
    W(f"SELECT count_if({O.mentions('Everyone')}) AS every FROM scan_results WHERE {R}"),
    overview.everyone_count,
    run_id=RUN,
)
inv_report(
    "legacy_naive_broken",
    W(f"SELECT count_if(parent_acl <> '' AND acl <> parent_acl) AS broken FROM scan_results WHERE {R}"),
    overview.naive_broken_count,
    run_id=RUN,
)

# ---------------------------------------------------------------- capacity
inv_report(
    "dept_breakdown",
    W(
        f"SELECT {O.DEPT} AS dept, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} AND {O.DEPT} <> '' GROUP BY 1"
    ),
    capacity.dept_breakdown,
    run_id=RUN,
)
inv_report(
    "dept_breakdown_pct",
    W(
        f"SELECT {O.DEPT} AS dept, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human, "
        f"{P('sum(size)', f'(SELECT sum(size) FROM scan_results WHERE {R})')} AS pct_bytes "
        f"FROM scan_results WHERE {R} GROUP BY 1 HAVING {O.DEPT} <> ''"
    ),
    capacity.dept_breakdown,
    run_id=RUN,
    pct=True,
)
inv_report(
    "dept_capacity_top16",
    W(
        f"SELECT {O.DEPT} AS dept, {S0('size')} AS bytes FROM scan_results WHERE {R} AND {O.DEPT} <> '' "
        f"GROUP BY 1 ORDER BY bytes DESC, dept LIMIT 16"
    ),
    capacity.dept_capacity_top,
    run_id=RUN,
)
YEAR = "CAST(year(created) AS INTEGER)"
inv_report(
    "year_histogram",
    W(
        f"SELECT {YEAR} AS year, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND year(created) BETWEEN 2015 AND 2027 GROUP BY 1"
    ),
    capacity.year_histogram,
    run_id=RUN,
)
inv_report(
    "year_histogram_pct",
    W(
        f"SELECT {YEAR} AS year, count(*) AS files, {S0('size')} AS bytes, "
        f"{P('count(*)', f'(SELECT count(*) FROM scan_results WHERE {R})')} AS pct_files FROM scan_results "
        f"WHERE {R} AND year(created) BETWEEN 2015 AND 2027 GROUP BY 1"
    ),
    capacity.year_histogram,
    run_id=RUN,
    pct=True,
)
inv_report(
    "year_histogram_files",
    W(
        f"SELECT {YEAR} AS year, count(*) AS files FROM scan_results "
        f"WHERE {R} AND year(created) BETWEEN 2015 AND 2027 GROUP BY 1"
    ),
    capacity.year_histogram,
    run_id=RUN,
    counts_only=True,
)
inv_report(
    "year_cohort_by_dept",
    W(
        f"SELECT {O.DEPT} AS dept, count(*) AS files_2019, {S0('size')} AS bytes_2019, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} AND year(created) = 2019 AND {O.DEPT} <> '' "
        f"GROUP BY 1 ORDER BY files_2019 DESC, dept LIMIT 10"
    ),
    capacity.year_cohort_by_dept,
    run_id=RUN,
    year=2019,
)
inv_report(
    "top_folders",
    W(
        f"SELECT {O.DEPT} AS top_folder, {S0('size')} AS bytes FROM scan_results WHERE {R} AND {O.DEPT} <> '' "
        f"GROUP BY 1 ORDER BY bytes DESC, top_folder LIMIT 20"
    ),
    capacity.top_folders,
    run_id=RUN,
)
LEGACY_TOP = r"regexp_extract(file_path, '^[^\/]*[\/]+[^\/]*[\/]+([^\/]+)', 1)"
inv_report(
    "top_folders_legacy",
    W(
        f"SELECT {LEGACY_TOP} AS top_folder, {S0('size')} AS bytes FROM scan_results WHERE {R} AND {LEGACY_TOP} <> '' "
        f"GROUP BY 1 ORDER BY bytes DESC, top_folder LIMIT 20"
    ),
    capacity.top_folders,
    run_id=RUN,
    legacy=True,
)
inv_report(
    "cold_folders",
    W(
        f"SELECT {O.DEPT} AS top_folder, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND {O.stale('last_accessed', 3)} AND {O.DEPT} <> '' GROUP BY 1 ORDER BY bytes DESC, top_folder LIMIT 25"
    ),
    capacity.cold_folders,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "cold_folders_legacy",
    W(
        f"SELECT {LEGACY_TOP} AS top_folder, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND {O.stale('modified', 3)} AND {LEGACY_TOP} <> '' GROUP BY 1 ORDER BY bytes DESC, top_folder LIMIT 25"
    ),
    capacity.cold_folders,
    run_id=RUN,
    as_of=AS_OF,
    by="modified",
    legacy=True,
)

# ---------------------------------------------------------------- ownership
CHARGE = f"CASE WHEN {O.GG} THEN owner_name ELSE 'UNATTRIBUTABLE' END"
CHARGE_EX = f"CASE WHEN {O.GG} AND owner_name <> {O.ALL_EMPLOYEES} THEN owner_name ELSE 'UNATTRIBUTABLE' END"
CHARGE_HYP = (
    f"CASE WHEN {O.ORPHAN} OR {O.SVC} OR owner_name = {O.BUILTIN} OR owner_name = {O.ALL_EMPLOYEES} "
    f"THEN 'UNATTRIBUTABLE' ELSE owner_name END"
)
inv_report(
    "chargeback",
    W(
        f"SELECT {CHARGE} AS chargeback_group, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} GROUP BY 1"
    ),
    ownership.chargeback,
    run_id=RUN,
)
inv_report(
    "chargeback_excl_all_employees",
    W(f"SELECT {CHARGE_EX} AS chargeback_group, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    ownership.chargeback,
    run_id=RUN,
    exclude_all_employees=True,
    bytes_only=True,
)
inv_report(
    "chargeback_hypothesis",
    W(
        f"SELECT {CHARGE_HYP} AS chargeback_group, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} GROUP BY 1"
    ),
    ownership.chargeback,
    run_id=RUN,
    mode="orphan_svc_admin_all",
)
OWNER_CLASS = (
    f"CASE WHEN {O.ORPHAN} THEN 'OrphanSid' WHEN {O.SVC} THEN 'ServiceAccount' "
    f"WHEN owner_name = {O.BUILTIN} THEN 'BuiltinAdmin' WHEN {O.GG} THEN 'DeptGroup' ELSE 'User' END"
)
inv_report(
    "ownership_split",
    W(f"SELECT {OWNER_CLASS} AS bucket, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    ownership.ownership_split,
    run_id=RUN,
)
inv_report(
    "ownership_split_pct",
    W(
        f"SELECT {OWNER_CLASS} AS bucket, count(*) AS files, {S0('size')} AS bytes, "
        f"{P('count(*)', f'(SELECT count(*) FROM scan_results WHERE {R})')} AS pct_files "
        f"FROM scan_results WHERE {R} GROUP BY 1"
    ),
    ownership.ownership_split,
    run_id=RUN,
    pct=True,
)
inv_report(
    "orphan_sids",
    W(
        f"SELECT owner_sid, min(owner_name) AS sample_name, count(*) AS files, {S0('size')} AS bytes, "
        f"min(modified) AS oldest_touch, max(modified) AS newest_touch FROM scan_results "
        f"WHERE {R} AND {O.ORPHAN} GROUP BY owner_sid ORDER BY files DESC, owner_sid LIMIT 25"
    ),
    ownership.orphan_sids,
    run_id=RUN,
)
inv_report(
    "orphan_worklist",
    W(
        f"SELECT owner_sid, min(owner_name) AS sample_name, count(*) AS files, {S0('size')} AS bytes, "
        f"min(modified) AS oldest, max(modified) AS newest FROM scan_results "
        f"WHERE {R} AND {O.ORPHAN} GROUP BY owner_sid ORDER BY bytes DESC, owner_sid LIMIT 50"
    ),
    ownership.orphan_sids,
    run_id=RUN,
    order_by="bytes",
    limit=50,
    touch=("oldest", "newest"),
)
inv_report(
    "orphan_worklist_legacy",
    W(
        f"SELECT owner_sid, min(owner_name) AS sample_name, count(*) AS files, {S0('size')} AS bytes, "
        f"min(modified) AS oldest, max(modified) AS newest FROM scan_results "
        f"WHERE {R} AND {O.ORPHAN_LEGACY} GROUP BY owner_sid ORDER BY bytes DESC, owner_sid LIMIT 50"
    ),
    ownership.orphan_sids,
    run_id=RUN,
    order_by="bytes",
    limit=50,
    touch=("oldest", "newest"),
    mode="legacy",
)
inv_report(
    "orphan_sids_export",
    W(
        f"SELECT owner_sid, min(owner_name) AS sample_name, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND {O.ORPHAN} GROUP BY owner_sid ORDER BY files DESC, owner_sid LIMIT 25"
    ),
    ownership.orphan_sids,
    run_id=RUN,
    touch=None,
)
inv_report(
    "service_accounts",
    W(
        f"SELECT owner_name, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} AND {O.SVC} GROUP BY 1"
    ),
    ownership.service_accounts,
    run_id=RUN,
)
inv_report(
    "service_accounts_bytes",
    W(f"SELECT owner_name, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} AND {O.SVC} GROUP BY 1"),
    ownership.service_accounts,
    run_id=RUN,
    human=False,
    order_by="bytes",
)
inv_report(
    "service_account_folders",
    W(
        f"SELECT owner_name, count(*) AS files, {S0('size')} AS bytes, count(DISTINCT file_path) AS folders "
        f"FROM scan_results WHERE {R} AND {O.SVC} GROUP BY 1"
    ),
    ownership.service_accounts,
    run_id=RUN,
    human=False,
    folders=True,
)
inv_report(
    "top_owners_bytes",
    W(
        f"SELECT owner_name, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1 "
        f"ORDER BY bytes DESC, owner_name LIMIT 10"
    ),
    ownership.top_owners,
    run_id=RUN,
)
inv_report(
    "top_owners_files",
    W(
        f"SELECT owner_name, count(*) AS files FROM scan_results WHERE {R} GROUP BY 1 "
        f"ORDER BY files DESC, owner_name LIMIT 20"
    ),
    ownership.top_owners,
    run_id=RUN,
    by="files",
    limit=20,
)

# ---------------------------------------------------------------- acl
inv_report(
    "acl_flag_distribution",
    W(
        f"SELECT acl_analysis, count(*) AS files FROM scan_results WHERE {R} GROUP BY 1 "
        f"ORDER BY files DESC, acl_analysis LIMIT 25"
    ),
    acl.acl_flag_distribution,
    run_id=RUN,
)
inv_report(
    "acl_flag_distribution_pct",
    W(
        f"SELECT acl_analysis, count(*) AS files, {P('count(*)', f'(SELECT count(*) FROM scan_results WHERE {R})')} AS pct "
        f"FROM scan_results WHERE {R} GROUP BY 1 ORDER BY files DESC, acl_analysis LIMIT 50"
    ),
    acl.acl_flag_distribution,
    run_id=RUN,
    limit=50,
    pct=True,
)
ACL_PATTERN = (
    f"CASE WHEN {O.mentions('DL_Share_')} THEN 'ProperAGDLP' "
    f"WHEN contains(lower(acl), lower('DEMO' || {O.BS} || 'GG_')) THEN 'LazyGG (direct global group on ACL)' "
    f"WHEN {O.mentions('Everyone')} THEN 'Everyone' WHEN {O.mentions('DENY')} THEN 'Deny' "
    f"WHEN {O.mentions('S-1-5-21')} THEN 'OrphanSid-ACE' ELSE 'Other' END"
)
inv_report(
    "acl_pattern_classifier",
    W(f"SELECT {ACL_PATTERN} AS pattern, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    acl.acl_pattern_classifier,
    run_id=RUN,
)
PREFIX6 = "array_to_string(string_split(file_path, '/')[1:6], '/')"
for _min in (1000, 100):
    inv_report(
        "top_dirs_broken_inheritance" + ("" if _min == 1000 else f"_min{_min}"),
        W(
            f"SELECT {PREFIX6} AS directory, count(*) AS broken_files, {S0('size')} AS broken_bytes, "
            f"{H('sum(size)')} AS broken_human FROM scan_results WHERE {R} AND {O.flag('B')} GROUP BY 1 "
            f"HAVING count(*) > {_min} ORDER BY broken_files DESC, directory LIMIT 10"
        ),
        acl.top_dirs_broken_inheritance,
        run_id=RUN,
        min_files=_min,
    )
ACE = "least(len(string_split(acl, ';')) - 1, 40)"
inv_report(
    "ace_count_distribution",
    W(f"SELECT CAST({ACE} AS VARCHAR) AS ace_count, count(*) AS files FROM scan_results WHERE {R} GROUP BY {ACE}"),
    acl.ace_count_distribution,
    run_id=RUN,
)
PARENT = r"regexp_replace(file_path, '([^\/]+)$', '')"
inv_report(
    "everyone_paths",
    W(
        f"SELECT {PARENT} AS parent_dir, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} AND {O.mentions('Everyone')} GROUP BY 1 ORDER BY files DESC, parent_dir LIMIT 50"
    ),
    acl.everyone_paths,
    run_id=RUN,
)
inv_report(
    "acl_folder_summary",
    W(
        f"SELECT file_path, count(*) AS entries, count_if({O.IS_DIR}) AS dirs, "
        + ", ".join(f"count_if({O.flag(f)}) AS flag_{f.lower()}" for f in acl.FOLDER_FLAGS)
        + f" FROM scan_results WHERE {R} GROUP BY file_path"
    ),
    acl.acl_folder_summary,
    run_id=RUN,
)

# ---------------------------------------------------------------- age
DORMANCY = (
    f"SELECT {O.DEPT} AS dept, "
    f"{P(f'count_if({O.stale('last_accessed', 1)})', 'count(*)', 1)} AS pct_aging_1y, "
    f"{P(f'count_if({O.stale('last_accessed', 3)})', 'count(*)', 1)} AS pct_dormant_3y, "
    f"{P(f'count_if({O.stale('last_accessed', 5)})', 'count(*)', 1)} AS pct_ancient_5y, "
    f"count(*) AS files FROM scan_results WHERE {R} AND {O.DEPT} <> '' GROUP BY 1 HAVING count(*) > 1000"
)
inv_report("dormancy_by_dept", W(DORMANCY), age.dormancy_by_dept, run_id=RUN, as_of=AS_OF)
def _colour(col: str, orange: int, red: int) -> str:
    return f"CASE WHEN {col} >= {red} THEN 'red' WHEN {col} >= {orange} THEN 'orange' ELSE 'green' END"


inv_report(
    "dormancy_status",
    W(
        f"SELECT *, {_colour('pct_aging_1y', 50, 80)} AS status_1y, {_colour('pct_dormant_3y', 50, 80)} AS status_3y, "
        f"{_colour('pct_ancient_5y', 30, 60)} AS status_5y FROM ({DORMANCY})"
    ),
    age.dormancy_by_dept,
    run_id=RUN,
    as_of=AS_OF,
    with_status=True,
)
inv_report(
    "dormancy_top16",
    W(DORMANCY + " ORDER BY pct_dormant_3y DESC, dept LIMIT 16"),
    age.dormancy_by_dept,
    run_id=RUN,
    as_of=AS_OF,
    order_by="pct_dormant_3y",
    limit=16,
)
ACCESS_BAND = (
    f"CASE WHEN last_accessed > {O.ago(90, 'DAY')} THEN '1_Active_lt90d' "
    f"WHEN last_accessed > {O.ago(1, 'YEAR')} THEN '2_Warm_90d-1y' "
    f"WHEN last_accessed > {O.ago(3, 'YEAR')} THEN '3_Cold_1-3y' ELSE '4_Frozen_3yplus' END"
)
inv_report(
    "age_bands",
    W(
        f"SELECT band, files, bytes, {H('bytes')} AS bytes_human, {P('files', 'sum(files) OVER ()')} AS pct_files, "
        f"{P('bytes', 'sum(bytes) OVER ()')} AS pct_bytes FROM "
        f"(SELECT {ACCESS_BAND} AS band, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1)"
    ),
    age.age_bands,
    run_id=RUN,
    as_of=AS_OF,
)
MOD_BAND = (
    f"CASE WHEN modified > {O.ago(90, 'DAY')} THEN 'Active (<90d)' WHEN modified > {O.ago(365, 'DAY')} THEN 'Warm (90d-1y)' "
    f"WHEN modified > {O.ago(3, 'YEAR')} THEN 'Cold (1-3y)' ELSE 'Frozen (3y+)' END"
)
inv_report(
    "capacity_by_age",
    W(f"SELECT {MOD_BAND} AS age, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    age.capacity_by_age,
    run_id=RUN,
    as_of=AS_OF,
)
_d90, _d365, _y3 = O.ago(90, "DAY"), O.ago(365, "DAY"), O.ago(3, "YEAR")
inv_report(
    "extension_age_matrix",
    W(
        f"SELECT extension, {SI(f'modified > {_d90}')} AS active_b, "
        f"{SI(f'modified <= {_d90} AND modified > {_d365}')} AS warm_b, "
        f"{SI(f'modified <= {_d365} AND modified > {_y3}')} AS cold_b, {SI(f'modified <= {_y3}')} AS frozen_b "
        f"FROM scan_results WHERE {R} GROUP BY extension "
        f"ORDER BY (active_b + warm_b + cold_b + frozen_b) DESC, extension LIMIT 25"
    ),
    age.extension_age_matrix,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "dept_age_heat",
    W(
        f"SELECT dept, band, files, {P('files', 'sum(files) OVER (PARTITION BY dept)')} AS pct_files FROM "
        f"(SELECT {O.DEPT} AS dept, {ACCESS_BAND} AS band, count(*) AS files FROM scan_results "
        f"WHERE {R} AND {O.DEPT} <> '' GROUP BY 1, 2)"
    ),
    age.dept_age_heat,
    run_id=RUN,
    as_of=AS_OF,
)
_lo30 = O.ago(30, "DAY")
inv_report(
    "daily_review",
    W(
        "SELECT kind, CAST(ts AS DATE) AS day, count(*) AS files, " + S0("size") + " AS bytes FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS kind, {c} AS ts, size FROM scan_results WHERE {R} AND {c} > {_lo30} AND {c} <= {O.AS_OF_TS}"
            for c in age.TIME_COLUMNS
        )
        + ") GROUP BY 1, 2"
    ),
    age.daily_review,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "cumulative_trend",
    W(
        "SELECT month, files, bytes, CAST(sum(files) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_files, "
        "CAST(sum(bytes) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_bytes FROM "
        f"(SELECT CAST(date_trunc('month', created) AS DATE) AS month, count(*) AS files, {S0('size')} AS bytes "
        f"FROM scan_results WHERE {R} AND created >= {O.ago(10, 'YEAR')} AND created < {O.AS_OF_TS} GROUP BY 1)"
    ),
    age.cumulative_trend,
    run_id=RUN,
    as_of=AS_OF,
)

# ---------------------------------------------------------------- size
inv_report(
    "extensions_by_bytes",
    W(
        f"SELECT extension, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human FROM scan_results "
        f"WHERE {R} GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 15"
    ),
    size.extensions,
    run_id=RUN,
)
inv_report(
    "extensions_by_bytes_export",
    W(
        f"SELECT extension, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human FROM scan_results "
        f"WHERE {R} GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 25"
    ),
    size.extensions,
    run_id=RUN,
    limit=25,
)
inv_report(
    "extensions_top10_bytes",
    W(
        f"SELECT extension, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1 "
        f"ORDER BY bytes DESC, extension LIMIT 10"
    ),
    size.extensions,
    run_id=RUN,
    limit=10,
    bytes_only=True,
)
inv_report(
    "extensions_by_files",
    W(
        f"SELECT extension, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1 "
        f"ORDER BY files DESC, extension LIMIT 25"
    ),
    size.extensions,
    run_id=RUN,
    order_by="files",
    limit=25,
    human=False,
)
LOG_BUCKET = (
    "CASE WHEN size < 1024 THEN '<1K' WHEN size < 1048576 THEN '1K-1M' WHEN size < 1073741824 THEN '1M-1G' "
    "WHEN size < 1099511627776 THEN '1G-1T' ELSE '>1T' END"
)
inv_report(
    "size_buckets",
    W(f"SELECT {LOG_BUCKET} AS bucket, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    size.size_buckets,
    run_id=RUN,
)
inv_report(
    "size_buckets_human",
    W(
        f"SELECT {LOG_BUCKET} AS bucket, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} GROUP BY 1"
    ),
    size.size_buckets,
    run_id=RUN,
    human=True,
)
SIZE_BAND = (
    "CASE WHEN size < 102400 THEN '1_<100K' WHEN size < 1048576 THEN '2_100K-1M' WHEN size < 10485760 THEN '3_1M-10M' "
    "WHEN size < 104857600 THEN '4_10M-100M' WHEN size < 1073741824 THEN '5_100M-1G' "
    "WHEN size < 10737418240 THEN '6_1G-10G' ELSE '7_>10G' END"
)
inv_report(
    "size_bands",
    W(
        f"SELECT {SIZE_BAND} AS size_band, count(*) AS files, {S0('size')} AS bytes, {H('sum(size)')} AS bytes_human "
        f"FROM scan_results WHERE {R} GROUP BY 1"
    ),
    size.size_bands,
    run_id=RUN,
)
_ranked = f"ranked AS (SELECT size AS v, row_number() OVER (ORDER BY size) - 1 AS rn, count(*) OVER () AS n FROM scan_results WHERE {R})"
_qcols = ", ".join(
    f"{O.quantile_at(q)} AS {nm}_bytes, {H(O.quantile_at(q))} AS {nm}_human" for nm, q in size.SIZE_QUANTILES.items()
)
_avg = f"(SELECT {O.dbl('sum(size)')} / count(*) FROM scan_results WHERE {R})"
inv_report(
    "size_quantiles",
    W(
        f"SELECT {_qcols}, {_avg} AS avg_bytes, {H(f'CAST(trunc({_avg}) AS BIGINT)')} AS avg_human FROM ranked",
        _ranked,
    ),
    size.size_quantiles,
    run_id=RUN,
)
_dranked = (
    f"ranked AS (SELECT {O.DEPTH} AS v, row_number() OVER (ORDER BY {O.DEPTH}) - 1 AS rn, count(*) OVER () AS n "
    f"FROM scan_results WHERE {R} AND file_path <> '')"
)
inv_report(
    "tree_depth",
    W(
        f"SELECT max(v) AS max_depth, {O.quantile_at(0.95)} AS p95_depth, {O.quantile_at(0.5)} AS p50_depth FROM ranked",
        _dranked,
    ),
    size.tree_depth,
    run_id=RUN,
)

# ---------------------------------------------------------------- duplicates
DUP = (
    f"dups AS (SELECT filename, size, count(*) AS copies, (count(*) - 1) * size AS wasted_bytes FROM scan_results "
    f"WHERE {R} AND size > 1048576 GROUP BY filename, size HAVING count(*) > 1)"
)
inv_report(
    "duplicate_clusters",
    W("SELECT * FROM dups ORDER BY wasted_bytes DESC, filename, size LIMIT 50", DUP),
    duplicates.duplicate_clusters,
    run_id=RUN,
)
inv_report(
    "duplicate_floor",
    W(
        f"SELECT count(*) AS dup_clusters, {S0('copies')} AS total_duplicate_files, {S0('wasted_bytes')} AS total_wasted_bytes, "
        f"{H(S0('wasted_bytes'))} AS total_wasted_human, {S0('copies - 1')} AS reclaimable_file_count FROM dups",
        DUP,
    ),
    duplicates.duplicate_floor,
    run_id=RUN,
)

# ---------------------------------------------------------------- cost
inv_report(
    "hot_cost",
    W(f"SELECT {O.dbl(S0('size'))} / {O.TIB} * {O.dbl(23)} AS usd_mo FROM scan_results WHERE {R}"),
    cost.hot_cost,
    run_id=RUN,
)
inv_report(
    "archive_savings",
    W(f"SELECT {O.dbl(SI(O.stale('last_accessed', 3)))} / {O.TIB} * {O.dbl(19)} AS savings FROM scan_results WHERE {R}"),
    cost.archive_savings,
    run_id=RUN,
    as_of=AS_OF,
)
inv_report(
    "archive_savings_legacy",
    W(f"SELECT {O.dbl(SI(O.stale('modified', 3)))} / {O.TIB} * {O.dbl(19)} AS savings FROM scan_results WHERE {R}"),
    cost.archive_savings,
    run_id=RUN,
    as_of=AS_OF,
    by="modified",
)
for _by, _nm in (("last_accessed", "frozen_by_extension"), ("modified", "frozen_by_extension_legacy")):
    inv_report(
        _nm,
        W(
            f"SELECT extension, count(*) AS files, {S0('size')} AS bytes, {O.dbl(S0('size'))} / {O.TIB} * {O.dbl(19)} AS savings_usd_mo "
            f"FROM scan_results WHERE {R} AND {O.stale(_by, 3)} GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 20"
        ),
        cost.frozen_by_extension,
        run_id=RUN,
        as_of=AS_OF,
        by=_by,
    )
for _by, _nm in (("last_accessed", "quick_wins"), ("modified", "quick_wins_legacy")):
    inv_report(
        _nm,
        W(
            f"SELECT filename, extension, size AS bytes, owner_name, modified FROM scan_results "
            f"WHERE {R} AND size > 1073741824 AND {O.stale(_by, 3)} "
            f"ORDER BY size DESC, filename, extension, owner_name, modified LIMIT 200"
        ),
        cost.quick_wins,
        run_id=RUN,
        as_of=AS_OF,
        by=_by,
    )
inv_report(
    "approx_physical",
    W(
        f"SELECT {S0('size')} AS logical_bytes, {O.dbl(S0('size'))} * {O.dbl(0.014)} AS approx_physical_bytes "
        f"FROM scan_results WHERE {R}"
    ),
    cost.approx_physical,
    run_id=RUN,
)

# ---------------------------------------------------------------- physical
PR = "run_id = 'run-2'"
phys_report(
    "probe_progress",
    W(f"SELECT count(*) AS probed, min(probed_at) AS started, max(probed_at) AS latest FROM file_physical WHERE {PR}"),
    physical.probe_progress,
    with_inv=False,
    run_id=RUN,
)
phys_report(
    "probe_progress_by_run",
    W(
        "SELECT run_id, count(*) AS probed, count(DISTINCT file_uri) AS distinct_files, min(probed_at) AS started, "
        "max(probed_at) AS latest FROM file_physical GROUP BY run_id"
    ),
    physical.probe_progress_by_run,
    with_inv=False,
)
phys_report(
    "coverage",
    W(
        f"SELECT e AS expected, p AS probed, e - p AS missing FROM "
        f"(SELECT (SELECT count(*) FROM scan_results WHERE {R} AND {O.IS_FILE}) AS e, "
        f"(SELECT count(DISTINCT file_uri) FROM file_physical WHERE {PR}) AS p)"
    ),
    physical.coverage,
    run_id=RUN,
)
phys_report(
    "missing_files",
    W(
        f"SELECT file_uri FROM scan_results s WHERE {R} AND {O.IS_FILE} AND NOT EXISTS "
        f"(SELECT 1 FROM file_physical p WHERE p.run_id = s.run_id AND p.file_uri = s.file_uri)"
    ),
    physical.missing_files,
    run_id=RUN,
)
phys_report(
    "orphan_probes",
    W(
        "SELECT DISTINCT run_id, file_uri FROM file_physical p WHERE NOT EXISTS "
        "(SELECT 1 FROM scan_results s WHERE p.run_id = s.run_id AND p.file_uri = s.file_uri)"
    ),
    orphan_probes,
)
phys_report(
    "physical_total",
    W(
        f"SELECT count(*) AS files, {S0('allocated')} AS physical_bytes, {H(S0('allocated'))} AS physical_total "
        f"FROM latest WHERE {PR}",
        O.LATEST,
    ),
    physical.physical_total,
    with_inv=False,
    run_id=RUN,
)
_lb = f"(SELECT {S0('size')} FROM scan_results WHERE {R} AND {O.IS_FILE})"
_pb = f"(SELECT {S0('allocated')} FROM latest WHERE {PR})"
phys_report(
    "physical_ratio",
    W(
        f"SELECT {_lb} AS logical_bytes, {_pb} AS physical_bytes, {H(_lb)} AS logical, {H(_pb)} AS physical, "
        f"round_even({O.dbl(_pb)} / {_lb}, 4) AS physical_over_logical",
        O.LATEST,
    ),
    physical.physical_ratio,
    run_id=RUN,
)
phys_report(
    "allocation_histogram",
    W(
        f"SELECT allocated, {H('allocated')} AS bucket, count(*) AS files, {H('sum(allocated)')} AS bytes "
        f"FROM latest WHERE {PR} GROUP BY allocated",
        O.LATEST,
    ),
    physical.allocation_histogram,
    with_inv=False,
    run_id=RUN,
)
phys_report(
    "physical_total_raw",
    W(
        f"SELECT count(*) AS files, {S0('allocated')} AS physical_bytes, {H(S0('allocated'))} AS physical_total "
        f"FROM file_physical WHERE {PR}"
    ),
    physical.physical_total,
    with_inv=False,
    run_id=RUN,
    dedupe=False,
)
_pb_raw = f"(SELECT {S0('allocated')} FROM file_physical WHERE {PR})"
phys_report(
    "physical_ratio_raw",
    W(
        f"SELECT {_lb} AS logical_bytes, {_pb_raw} AS physical_bytes, {H(_lb)} AS logical, {H(_pb_raw)} AS physical, "
        f"round_even({O.dbl(_pb_raw)} / {_lb}, 4) AS physical_over_logical"
    ),
    physical.physical_ratio,
    run_id=RUN,
    dedupe=False,
)
phys_report(
    "allocation_histogram_raw",
    W(
        f"SELECT allocated, {H('allocated')} AS bucket, count(*) AS files, {H('sum(allocated)')} AS bytes "
        f"FROM file_physical WHERE {PR} GROUP BY allocated"
    ),
    physical.allocation_histogram,
    with_inv=False,
    run_id=RUN,
    dedupe=False,
)
phys_report(
    "allocation_share",
    W(
        f"SELECT count(*) AS files, count_if(allocated = 131072) AS at_cluster, count_if(allocated < 131072) AS below_cluster, "
        f"{P('count_if(allocated = 131072)', 'count(*)')} AS pct_at_cluster, "
        f"{P('count_if(allocated < 131072)', 'count(*)')} AS pct_below_cluster FROM latest WHERE {PR}",
        O.LATEST,
    ),
    physical.allocation_share,
    with_inv=False,
    run_id=RUN,
)
_tiles = W(
    f"SELECT {S0('s.size')} AS logical_bytes, {S0('l.allocated')} AS on_disk_bytes, count(l.allocated) AS probed_files, "
    f"count(*) AS files, {H(S0('s.size'))} AS logical_capacity, {H('COALESCE(sum(l.allocated), 0)')} AS on_disk_capacity "
    f"FROM scan_results s LEFT JOIN (SELECT * FROM latest WHERE {PR}) l ON l.run_id = s.run_id AND l.file_uri = s.file_uri "
    f"WHERE s.{R} AND s.filename <> ''",
    O.LATEST,
)
phys_report("logical_physical_tiles", _tiles, physical.logical_physical_tiles, run_id=RUN)
phys_report("logical_physical_sums", _tiles, physical.logical_physical_tiles, run_id=RUN, method="sums")
phys_report(
    "capacity_physical",
    W(
        f"SELECT {S0('l.allocated')} AS capacity_bytes, {H('COALESCE(sum(l.allocated), 0)')} AS capacity_human "
        f"FROM scan_results s LEFT JOIN (SELECT * FROM latest WHERE {PR}) l ON l.run_id = s.run_id AND l.file_uri = s.file_uri "
        f"WHERE s.{R} AND s.filename <> ''",
        O.LATEST,
    ),
    physical.capacity_tile,
    run_id=RUN,
    size_metric="Physical",
)
phys_report(
    "capacity_logical",
    W(
        f"SELECT {S0('size')} AS capacity_bytes, {H('COALESCE(sum(size), 0)')} AS capacity_human "
        f"FROM scan_results WHERE {R} AND filename <> ''"
    ),
    physical.capacity_tile,
    run_id=RUN,
    size_metric="Logical",
)

# ---------------------------------------------------------------- runs
inv_report(
    "run_list",
    W("SELECT run_id, max(run_start_time) AS run_start_time FROM scan_results GROUP BY run_id"),
    runs.run_list,
)
inv_report(
    "run_trend",
    W(
        f"SELECT run_id, max(run_start_time) AS run_start_time, count(*) AS files, {S0('size')} AS bytes, "
        f"count_if({O.ORPHAN}) AS orphan_files, {SI(O.ORPHAN)} AS orphan_bytes FROM scan_results GROUP BY run_id"
    ),
    runs.run_trend,
)
inv_report(
    "inventory_snapshot",
    W(
        "SELECT count(*) AS rows, count(DISTINCT run_id) AS runs, strftime(max(modified), '%Y-%m-%d %H:%M:%S.%g') AS newest_modified, "
        f"{H(S0('size'))} AS total_bytes FROM scan_results"
    ),
    runs.inventory_snapshot,
)
_SNAPSHOT_SQL = W(
    "SELECT count(*) AS rows, count(DISTINCT run_id) AS runs, strftime(max(modified), '%Y-%m-%d %H:%M:%S.%g') AS newest_modified, "
    f"{H(S0('size'))} AS total_bytes FROM scan_results"
)


def _orders_stream(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` of the given scale as a file stream; a stream's source is a folder, so a single file is picked by name."""
    path = f"{sf.rstrip('/')}/orders.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.option("pathGlobFilter", "orders.parquet").parquet(sf) if one_file else stream.parquet(path)


def _drained(agg: DataFrame, kind: str) -> DataFrame:
    """Runs a monitor over all input that is there and returns its table: one row per run."""
    import uuid

    from invlens.session import checkpoint_dir
    from invlens.streaming import start_monitor

    spark, tag = agg.sparkSession, uuid.uuid4().hex[:12]
    name = f"{kind}_monitor_{tag}"
    query = start_monitor(agg, name, f"{checkpoint_dir(spark).rstrip('/')}/invlens-{kind}-{tag}", available_now=True)
    query.awaitTermination()
    return spark.table(name)


@register("inventory_monitor_stream", _SNAPSHOT_SQL)
def _inventory_monitor_stream(spark: SparkSession, sf: str) -> DataFrame:
    """M1 as a real stream: ``orders`` is streamed through the inventory
    derivation and aggregated per run; the runs are then added up exactly."""
    from invlens.streaming import inventory_totals, monitor_inventory

    return inventory_totals(_drained(monitor_inventory(scan_results_from_orders(_orders_stream(spark, sf))), "inventory"))


@register(
    "probe_monitor_stream",
    W("SELECT run_id, count(*) AS probed, min(probed_at) AS started, max(probed_at) AS latest FROM file_physical GROUP BY run_id"),
)
def _probe_monitor_stream(spark: SparkSession, sf: str) -> DataFrame:
    """M2 as a real stream over the probe rows derived from streamed ``orders``."""
    from invlens.streaming import monitor_probes

    return _drained(monitor_probes(file_physical_from_inventory(scan_results_from_orders(_orders_stream(spark, sf)))), "probe")


@register(
    "probe_completion",
    W(
        "SELECT run_id, count(DISTINCT file_uri) AS files_probed, CAST(1000 AS BIGINT) AS expected, "
        "100.0::DOUBLE * count(DISTINCT file_uri) / 1000 AS pct_done, count(DISTINCT file_uri) >= 1000 AS done FROM file_physical GROUP BY run_id"
    ),
)
def _probe_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct files probed per run against an expected number; re-probes don't count."""
    from invlens.streaming import probe_completion

    return probe_completion(fixture_tables(spark, sf)[1], 1000)


@register(
    "probe_load_stream",
    W("SELECT run_id, count(*) AS probes, count(DISTINCT file_uri) AS files, CAST(sum(allocated) AS BIGINT) AS allocated FROM file_physical GROUP BY run_id"),
)
def _probe_load_stream(spark: SparkSession, sf: str) -> DataFrame:
    """M3: first probes arrive as text in two streamed loads, re-probes by a batch append; all are in one table.

    The text and the table live under the session's checkpoint folder until
    the answer (a row per run) is there.
    """
    import uuid

    from invlens.session import checkpoint_dir
    from invlens.sources.inventory import read_physical
    from invlens.sources.probes import append_physical
    from invlens.streaming import load_probe_stream

    base = f"{checkpoint_dir(spark).rstrip('/')}/invlens-load-{uuid.uuid4().hex[:12]}"
    phys = fixture_tables(spark, sf)[1]
    first = F.col("probed_at") == F.lit(PROBE_TS[0]).cast("timestamp_ntz")
    line = F.concat_ws("\t", "run_id", "file_uri", F.col("allocated").cast("string")).alias("value")
    for run in (PREVIOUS_RUN, RUN):
        phys.where(first & (F.col("run_id") == run)).select(line).write.mode("append").text(f"{base}/lines")
        load_probe_stream(spark, f"{base}/lines", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    append_physical(phys.where(~first), f"{base}/table")
    got = read_physical(spark, f"{base}/table").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("probes"), F.count_distinct("file_uri").alias("files"), F.sum("allocated").alias("allocated")
    )
    out = spark.createDataFrame(got.collect(), got.schema)  # a row per run
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return out


# ------------------------------------------------------- probe feed and result texts
phys_report(
    "probe_feed",
    W(f"SELECT run_id, file_uri FROM scan_results WHERE {R} AND {O.IS_FILE}"),
    lambda inv, phys: probes.probe_feed(inv, RUN),
)
phys_report(
    "windows_paths",
    W(
        "SELECT file_uri, 'S:' || chr(92) || replace(url_decode(substr(file_uri, length('win://host/S/') + 1)), '/', chr(92)) AS win_path "
        f"FROM scan_results WHERE {R} AND {O.IS_FILE}"
    ),
    lambda inv, phys: probes.classify_probe_rows(probes.probe_feed(inv, RUN)).select("file_uri", "win_path"),
)


def _result_lines(phys: DataFrame) -> DataFrame:
    """Probe result lines of which some don't parse: the number is text, a tab is missing, or both."""
    n = F.col("allocated")
    number = F.when(n % 7 == 0, F.lit("n/a")).otherwise(n.cast("string"))
    whole = F.concat_ws("\t", "run_id", "file_uri", number)
    return phys.select(F.when(n % 7 == 1, F.col("file_uri")).when(n % 7 == 2, F.concat_ws("\t", "run_id", "file_uri")).otherwise(whole).alias("value"))


phys_report(
    "probe_results_parsed",
    W("SELECT run_id, file_uri, allocated FROM file_physical WHERE allocated % 7 > 2"),
    lambda inv, phys: probes.parse_probe_results(_result_lines(phys)).drop("probed_at"),
)
phys_report(
    "probe_rejects",
    W(
        "SELECT CASE allocated % 7 WHEN 0 THEN 'BAD_NUMBER' WHEN 1 THEN 'NO_TAB' ELSE 'ONE_TAB' END AS reject_reason, "
        "CASE allocated % 7 WHEN 0 THEN run_id || chr(9) || file_uri || chr(9) || 'n/a' WHEN 1 THEN file_uri ELSE run_id || chr(9) || file_uri END AS original "
        "FROM file_physical WHERE allocated % 7 <= 2"
    ),
    lambda inv, phys: probes.probe_result_rejects(_result_lines(phys)),
)
inv_report(
    "strict_orphan_count",
    W(f"SELECT count_if(owner_sid <> '' AND owner_name LIKE 'S-1-%') AS orphans FROM scan_results WHERE {R}"),
    overview.orphan_count,
    run_id=RUN,
    mode="strict",
)
for _mode, _else in (("zero", "0"), ("logical", "s.size")):
    phys_report(
        f"capacity_physical_missing_{_mode}",
        W(
            f"SELECT CAST(sum(COALESCE(l.allocated, {_else})) AS BIGINT) AS capacity_bytes FROM scan_results s "
            f"LEFT JOIN (SELECT * FROM latest WHERE {PR}) l ON l.run_id = s.run_id AND l.file_uri = s.file_uri WHERE s.{R} AND s.filename <> ''",
            O.LATEST,
        ),
        capacity_of_files,
        run_id=RUN,
        size_metric="Physical",
        on_missing=_mode,
    )
phys_report(
    "missing_files_first20",
    W(
        f"SELECT file_uri FROM scan_results s WHERE {R} AND {O.IS_FILE} AND NOT EXISTS "
        f"(SELECT 1 FROM file_physical p WHERE p.run_id = s.run_id AND p.file_uri = s.file_uri) ORDER BY file_uri LIMIT 20"
    ),
    missing_probes,
    run_id=RUN,
    limit=20,
)


@register(
    "content_duplicates",
    "SELECT hash, size, count(*) AS copies, CAST((count(*) - 1) * size AS BIGINT) AS wasted_bytes FROM "
    "(SELECT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents) WHERE size > 0 GROUP BY hash, size HAVING count(*) >= 2",
)
def _content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """R70 over the documents as files: equal content by hash and size."""
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    files = docs.select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return duplicates.content_duplicates(files).select("hash", "size", "copies", "wasted_bytes")


_dept_run = lambda r: (
    f"SELECT {O.DEPT} AS dept, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
    f"WHERE run_id = '{r}' AND {O.DEPT} <> '' GROUP BY 1"
)
inv_report(
    "compare_dept_runs",
    W(
        "SELECT COALESCE(b.dept, a.dept) AS dept, b.files AS files_before, b.bytes AS bytes_before, "
        "a.files AS files_after, a.bytes AS bytes_after, "
        "COALESCE(a.files, 0) - COALESCE(b.files, 0) AS files_delta, COALESCE(a.bytes, 0) - COALESCE(b.bytes, 0) AS bytes_delta "
        f"FROM ({_dept_run(PREVIOUS_RUN)}) b FULL OUTER JOIN ({_dept_run(RUN)}) a ON a.dept = b.dept"
    ),
    runs.compare_dept_runs,
    run_before=PREVIOUS_RUN,
    run_after=RUN,
)

_ov_metrics = (
    f"CAST(count(*) AS DOUBLE) AS files, CAST({S0('size')} AS DOUBLE) AS logical_bytes, "
    f"CAST(count(DISTINCT owner_sid) AS DOUBLE) AS unique_owners, "
    f"{P(f'count_if({O.stale('last_accessed', 3)})', 'count(*)')} AS pct_dormant_3y, "
    f"{P(f'count_if({O.ORPHAN})', 'count(*)')} AS pct_orphan, "
    f"{P(f'count_if({O.flag('W')})', 'count(*)')} AS pct_widens_access, "
    f"{P(f'count_if({O.flag('B')})', 'count(*)')} AS pct_broken_inherit"
)
inv_report(
    "reconcile_runs",
    W(
        "SELECT a.metric, a.v AS value, b.v AS expected, abs(a.v - b.v) AS abs_diff, "
        "abs(a.v - b.v) / abs(b.v) AS rel_diff, "
        f"COALESCE(abs(a.v - b.v) / abs(b.v) <= {O.dbl(0.05)}, abs(a.v - b.v) = 0, false) AS within "
        f"FROM lng a JOIN lng b ON a.metric = b.metric AND a.run_id = '{RUN}' AND b.run_id = '{PREVIOUS_RUN}'",
        f"ov AS (SELECT run_id, {_ov_metrics} FROM scan_results GROUP BY run_id), "
        "lng AS (UNPIVOT ov ON files, logical_bytes, unique_owners, pct_dormant_3y, pct_orphan, pct_widens_access, "
        "pct_broken_inherit INTO NAME metric VALUE v)",
    ),
    runs.reconcile_runs,
    run_expected=PREVIOUS_RUN,
    run_actual=RUN,
    as_of=AS_OF,
)

# ---------------------------------------------------------------- folders and attributes
_levels = (
    "SELECT file_path, files, dirs, bytes, unnest(range(1, greatest("
    f"{O.DEPTH} - 1, 1) + 1)) AS level FROM per_folder"
)
inv_report(
    "directory_usage",
    W(
        "SELECT array_to_string(string_split(file_path, '/')[1:level], '/') || '/' AS directory, CAST(level AS INTEGER) AS level, "
        f"{S0('files')} AS files, {S0('dirs')} AS dirs, {S0('bytes')} AS bytes FROM ({_levels}) GROUP BY 1, 2",
        f"per_folder AS (SELECT file_path, count_if({O.IS_FILE}) AS files, count_if({O.IS_DIR}) AS dirs, "
        f"{S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY file_path)",
    ),
    directory.directory_usage,
    run_id=RUN,
)
inv_report(
    "source_slice",
    W(
        "SELECT regexp_extract(file_uri, '^(win://[^/]+/[^/]+)/', 1) AS source, count(*) AS files, "
        f"{S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"
    ),
    directory.source_slice,
    run_id=RUN,
)
inv_report(
    "ads_breakdown",
    W(f"SELECT win_ads_names, count(*) AS files, {S0('size')} AS bytes FROM scan_results WHERE {R} GROUP BY 1"),
    directory.ads_breakdown,
    run_id=RUN,
)
inv_report(
    "migrated_share",
    W(
        f"SELECT count_if(migrated) AS migrated_files, {SI('migrated')} AS migrated_bytes, "
        f"{P('count_if(migrated)', 'count(*)')} AS pct_migrated_files, {P(SI('migrated'), 'sum(size)')} AS pct_migrated_bytes "
        f"FROM scan_results WHERE {R}"
    ),
    directory.migrated_share,
    run_id=RUN,
)
inv_report(
    "storage_tiers",
    W(
        f"SELECT storage_class, storage_state, count(*) AS files, {S0('size')} AS bytes FROM scan_results "
        f"WHERE {R} GROUP BY 1, 2"
    ),
    directory.storage_tiers,
    run_id=RUN,
)


from invlens import catalog_runs  # noqa: E402, F401  (registers its entries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {e.name: e.build for e in ENTRIES}


def oracle() -> dict[str, str]:
    return {e.name: e.sql for e in ENTRIES if e.sql is not None}
