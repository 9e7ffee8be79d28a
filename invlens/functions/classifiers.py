"""First-match classifiers (``CASE WHEN`` chains as Columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from invlens.functions.predicates import (
    BUILTIN_ADMINS,
    _c,
    is_dept_group,
    is_orphan,
    is_service_account,
)
from invlens.functions.timeutil import minus

# Fixed values that must equal the reference's for the same results.
UNATTRIBUTABLE = "UNATTRIBUTABLE"
ALL_EMPLOYEES_GROUP = "GG_AllEmployees"

# (case-insensitive needle in the raw ACL, pattern label), first match wins.
ACL_PATTERNS = (
    ("DL_Share_", "ProperAGDLP"),
    ("DEMO\\GG_", "LazyGG (direct global group on ACL)"),
    ("Everyone", "Everyone"),
    ("DENY", "Deny"),
    ("S-1-5-21", "OrphanSid-ACE"),
)
ACL_PATTERN_OTHER = "Other"

# Log-scale size buckets: (exclusive upper bound, label); last label is the rest.
LOG_SIZE_BUCKETS = (
    (1024, "<1K"),
    (1048576, "1K-1M"),
    (1073741824, "1M-1G"),
    (1099511627776, "1G-1T"),
)
LOG_SIZE_REST = ">1T"

# Seven numbered size bands (the reference calls the file "6band").
SIZE_BANDS = (
    (102400, "1_<100K"),
    (1048576, "2_100K-1M"),
    (10485760, "3_1M-10M"),
    (104857600, "4_10M-100M"),
    (1073741824, "5_100M-1G"),
    (10737418240, "6_1G-10G"),
)
SIZE_BANDS_REST = "7_>10G"

# Age bands: (amount, unit, label) meaning ``column > as_of - amount unit``.
MODIFIED_AGE_BANDS = (
    (90, "DAY", "Active (<90d)"),
    (365, "DAY", "Warm (90d-1y)"),
    (3, "YEAR", "Cold (1-3y)"),
)
MODIFIED_AGE_REST = "Frozen (3y+)"

ACCESS_AGE_BANDS = (
    (90, "DAY", "1_Active_lt90d"),
    (1, "YEAR", "2_Warm_90d-1y"),
    (3, "YEAR", "3_Cold_1-3y"),
)
ACCESS_AGE_REST = "4_Frozen_3yplus"

# Threshold colours of the dashboard stat panels: base, then (minimum, colour).
ORPHAN_PCT_STEPS = ("green", ((1, "orange"), (5, "red")))
DORMANCY_PCT_STEPS = ("green", ((50, "orange"), (80, "red")))
ANCIENT_PCT_STEPS = ("green", ((30, "orange"), (60, "red")))


def owner_class(owner="owner_name", domain: str = "DEMO") -> Column:
    """OrphanSid, ServiceAccount, BuiltinAdmin, DeptGroup or User."""
    o = _c(owner)
    return (
        F.when(is_orphan("current", o), "OrphanSid")
        .when(is_service_account(domain, o), "ServiceAccount")
        .when(o == BUILTIN_ADMINS, "BuiltinAdmin")
        .when(is_dept_group(domain, o), "DeptGroup")
        .otherwise("User")
    )


def chargeback_group(
    owner="owner_name", domain: str = "DEMO", exclude_all_employees: bool = False, mode: str | None = None
) -> Column:
    """Owning department group, else ``UNATTRIBUTABLE``.

    ``exclude_all_employees`` also sends the company-wide group to
    UNATTRIBUTABLE. ``mode='orphan_svc_admin_all'`` is a hypothesis about
    the scanner's own chargeback report: only orphan, service, builtin-admin
    and all-employee owners are unattributable; users keep their own name.
    """
    o = _c(owner)
    everyone = f"{domain}\\{ALL_EMPLOYEES_GROUP}"
    if mode == "orphan_svc_admin_all":
        unattributable = (
            is_orphan("current", o) | is_service_account(domain, o) | (o == BUILTIN_ADMINS) | (o == everyone)
        )
        return F.when(unattributable, UNATTRIBUTABLE).otherwise(o)
    if mode not in (None, "groups"):
        raise ValueError(f"unknown chargeback mode {mode!r}")
    cond = is_dept_group(domain, o)
    if exclude_all_employees:
        cond = cond & (o != everyone)
    return F.when(cond, o).otherwise(UNATTRIBUTABLE)


def acl_pattern(column="acl", patterns=ACL_PATTERNS, other: str = ACL_PATTERN_OTHER) -> Column:
    """Classify the raw ACL text by the first needle it contains (any case)."""
    low = F.lower(_c(column))
    chain = None
    for needle, label in patterns:
        cond = low.contains(needle.lower())
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(other)


def size_band(edges: Sequence[tuple[int, str]] = LOG_SIZE_BUCKETS, rest: str = LOG_SIZE_REST, column="size") -> Column:
    """First band whose exclusive upper bound exceeds the value."""
    c = _c(column)
    chain = None
    for upper, label in edges:
        chain = F.when(c < upper, label) if chain is None else chain.when(c < upper, label)
    return chain.otherwise(rest)


def age_band(column="modified", edges=MODIFIED_AGE_BANDS, rest: str = MODIFIED_AGE_REST, as_of=None) -> Column:
    """First band with ``column > as_of - interval``; exactly on an edge falls through."""
    c = _c(column)
    chain = None
    for amount, unit, label in edges:
        cond = c > minus(as_of, amount, unit)
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(rest)


def status(value, steps=ORPHAN_PCT_STEPS) -> Column:
    """Dashboard threshold colour: base colour, then the highest step reached."""
    base, thresholds = steps
    v = _c(value)
    chain = None
    for minimum, colour in sorted(thresholds, key=lambda s: s[0], reverse=True):
        cond = v >= minimum
        chain = F.when(cond, colour) if chain is None else chain.when(cond, colour)
    return F.lit(base) if chain is None else chain.otherwise(base)
