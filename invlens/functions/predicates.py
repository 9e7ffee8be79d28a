"""Row predicates over ``scan_results`` (boolean Columns, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invlens.functions.timeutil import days_before, years_before

# Fixed values that must equal the reference's for the same results.
ORPHAN_SID_PREFIX = "S-1-"
LEGACY_ORPHAN_MARKER = "unresolv"
BUILTIN_ADMINS = "BUILTIN\\Administrators"
ENCODED_PATTERN = "%[0-9A-Fa-f]{2}"
NON_ASCII_PATTERN = "[^\\x00-\\x7F]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like_prefix_one_more(c, prefix: str) -> Column:
    """SQL ``c LIKE '<prefix>_%'`` with a literal backslash in ``prefix``.

    ``_`` is a one-character wildcard, so the match is ``prefix`` followed by
    at least one more character. Written as ``startswith`` so the test stays
    in generated code and can reach the Parquet reader as a string filter.
    """
    c = _c(c)
    return c.startswith(prefix) & (F.length(c) > len(prefix))


def is_orphan(mode: str = "current", owner="owner_name", sid="owner_sid") -> Column:
    """Owner is an unresolved SID.

    * ``current``: name starts with ``S-1-`` or is empty.
    * ``legacy``: also any name containing ``unresolv`` (any case).
    * ``strict``: a non-empty SID and a name starting with ``S-1-``.
    """
    o = _c(owner)
    if mode == "current":
        return o.startswith(ORPHAN_SID_PREFIX) | (o == "")
    if mode == "legacy":
        return o.startswith(ORPHAN_SID_PREFIX) | (o == "") | F.lower(o).contains(LEGACY_ORPHAN_MARKER)
    if mode == "strict":
        return (_c(sid) != "") & o.startswith(ORPHAN_SID_PREFIX)
    raise ValueError(f"unknown orphan mode {mode!r}")


def has_flag(letter: str, case_sensitive: bool = False, column="acl_analysis") -> Column:
    """``acl_analysis`` carries flag ``letter``.

    The reference tests flags case-insensitively, so ``P`` also hits ``p``;
    ``case_sensitive=True`` is the corrected reading.
    """
    c = _c(column)
    if case_sensitive:
        return c.contains(letter)
    return F.lower(c).contains(letter.lower())


def naive_broken(acl="acl", parent_acl="parent_acl") -> Column:
    """Older broken-inheritance test: parent ACL present and different."""
    return (_c(parent_acl) != "") & (_c(acl) != _c(parent_acl))


def acl_mentions(word: str, column="acl") -> Column:
    """Raw ACL text contains ``word`` (any case), e.g. ``Everyone``."""
    return F.lower(_c(column)).contains(word.lower())


def is_service_account(domain: str = "DEMO", owner="owner_name") -> Column:
    """Owner matches ``<domain>\\svc_%`` (with ``_`` as wildcard)."""
    return like_prefix_one_more(owner, domain + "\\svc")


def is_dept_group(domain: str = "DEMO", owner="owner_name") -> Column:
    """Owner matches ``<domain>\\GG_%`` (with ``_`` as wildcard)."""
    return like_prefix_one_more(owner, domain + "\\GG")


def is_file(filename="filename") -> Column:
    return _c(filename) != ""


def is_directory(size="size", filename="filename", uri="file_uri") -> Column:
    return (_c(size) == 0) & (_c(filename) == "") & _c(uri).endswith("/")


def stale(column: str = "last_accessed", years: int = 3, as_of=None) -> Column:
    """``column < as_of - INTERVAL years YEAR`` (strict)."""
    return _c(column) < years_before(as_of, years)


def newer_than(column: str = "modified", days: int = 1, as_of=None) -> Column:
    """``column > as_of - INTERVAL days DAY`` (future dates included)."""
    return _c(column) > days_before(as_of, days)


def large_and_stale(min_size: int = 1073741824, years: int = 3, as_of=None, column="last_accessed") -> Column:
    return (F.col("size") > min_size) & stale(column, years, as_of)


def size_over(n: int, column="size") -> Column:
    return _c(column) > n


def year_between(column: str = "created", lo: int = 2015, hi: int = 2027) -> Column:
    return F.year(_c(column)).between(lo, hi)


def year_is(column: str = "created", year: int = 2019) -> Column:
    return F.year(_c(column)) == year


def has_dept(column="file_path") -> Column:
    from invlens.functions.scalars import path_part

    return path_part(4, column) != ""


def is_encoded(column="file_uri") -> Column:
    return _c(column).rlike(ENCODED_PATTERN)


def is_non_ascii(column="file_uri") -> Column:
    return _c(column).rlike(NON_ASCII_PATTERN)
