"""SQL text helpers for the DuckDB oracle of each registered report.

The oracle is an independent formulation of every report in plain SQL
over the same fixture; these helpers spell the shared expressions once
so that each oracle query stays short. Rounding follows the reports:
half-to-even on the binary value (DuckDB ``round_even``), and sizes as
IEC text with two decimals.
"""

from __future__ import annotations

from invlens.sources.fixture import AS_OF, DEFAULT_RUN, FIXTURE_SQL

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
RUN = f"run_id = '{DEFAULT_RUN}'"
BS = "chr(92)"


def bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``.

    DuckDB's ``count_if`` is HUGEINT while Spark's is BIGINT; the oracle
    keeps result types equal. Parentheses inside quoted text are skipped.
    """
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, quoted = 0, j + len(token) - 1, False
        while k < len(sql):
            ch = sql[k]
            if ch == "'":
                quoted = not quoted
            elif not quoted and ch == "(":
                depth += 1
            elif not quoted and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(f"CAST({sql[j:k + 1]} AS BIGINT)")
        i = k + 1


def with_fixture(body: str, ctes: str = "") -> str:
    extra = f", {bigint_counts(ctes)}" if ctes else ""
    return f"WITH {FIXTURE_SQL}{extra}\n{bigint_counts(body)}"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def human(x: str) -> str:
    v = dbl(x)
    parts = []
    for i, unit in enumerate(UNITS):
        scaled = v if i == 0 else f"{v} / {dbl(1024**i)}"
        text = f"printf('%.2f %s', round_even({scaled}, 2), '{unit}')"
        if i < len(UNITS) - 1:
            parts.append(f"WHEN {v} < {dbl(1024 ** (i + 1))} THEN {text}")
        else:
            parts.append(f"ELSE {text}")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL {' '.join(parts)} END)"


def pct(a: str, b: str, digits: int | None = 2) -> str:
    raw = f"({dbl(100)} * ({a}) / ({b}))"
    return raw if digits is None else f"round_even({raw}, {digits})"


def sum0(x: str) -> str:
    return f"COALESCE(CAST(sum({x}) AS BIGINT), 0)"


def sum_if(cond: str, x: str = "size") -> str:
    return f"COALESCE(CAST(sum(CASE WHEN {cond} THEN {x} ELSE 0 END) AS BIGINT), 0)"


def ago(n: int, unit: str) -> str:
    return f"(TIMESTAMP '{AS_OF}' - INTERVAL {int(n)} {unit})"


AS_OF_TS = f"TIMESTAMP '{AS_OF}'"
DEPT = "split_part(file_path, '/', 4)"
ORPHAN = "(owner_name LIKE 'S-1-%' OR owner_name = '')"
ORPHAN_LEGACY = "(owner_name LIKE 'S-1-%' OR owner_name = '' OR contains(lower(owner_name), 'unresolv'))"
SVC = f"(owner_name LIKE 'DEMO' || {BS} || 'svc_%')"
GG = f"(owner_name LIKE 'DEMO' || {BS} || 'GG_%')"
ALL_EMPLOYEES = f"('DEMO' || {BS} || 'GG_AllEmployees')"
BUILTIN = f"('BUILTIN' || {BS} || 'Administrators')"
IS_FILE = "(filename <> '')"
IS_DIR = "(size = 0 AND filename = '' AND file_uri LIKE '%/')"
TIB = dbl(1099511627776)
DEPTH = "CAST(len(string_split(file_path, '/')) AS INTEGER)"
LATEST = (
    "latest AS (SELECT run_id, file_uri, arg_max(allocated, (probed_at, allocated)) AS allocated, "
    "max(probed_at) AS probed_at FROM file_physical GROUP BY run_id, file_uri)"
)


def flag(letter: str, column: str = "acl_analysis") -> str:
    return f"contains(lower({column}), '{letter.lower()}')"


def mentions(word: str, column: str = "acl") -> str:
    return f"contains(lower({column}), '{word.lower()}')"


def stale(column: str, years: int) -> str:
    return f"({column} < {ago(years, 'YEAR')})"


def quantile_at(q: float, value: str = "v") -> str:
    """Element at 0-based rank floor(q*n) (n-1 for q >= 1) over a ranked CTE (v, rn, n)."""
    rank = "(n - 1)" if q >= 1 else f"CAST(floor({dbl(q)} * n) AS BIGINT)"
    return f"max(CASE WHEN rn = {rank} THEN {value} END)"
