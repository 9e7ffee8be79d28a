"""Scalar Column builders: paths, sizes, rounding, URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invlens.functions.predicates import _c

# Fixed values that must equal the reference's for the same results.
IEC_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
TIB = 1099511627776.0  # pow(1024, 4)
LEGACY_TOP_FOLDER_RE = r"^[^\/]*[\/]+[^\/]*[\/]+([^\/]+)"
WIN_URI_RE = r"(?i)^win://[^/]+/([A-Za-z])/(.*)$"
SOURCE_RE = r"^(win://[^/]+/[^/]+)/"
LAST_SEGMENT_RE = r"([^\/]+)$"
LONG_PATH_LIMIT = 248
LONG_PATH_PREFIX = "\\\\?\\"
ACE_CAP = 40


def path_part(n: int, column="file_path") -> Column:
    """``n``-th '/'-separated part, 1-based; '' when out of range.

    Same result as ``split_part(p, '/', n)``, but written with
    ``substring_index`` (no per-row array), which is several times cheaper:
    the part exists when at least ``n - 1`` separators precede the end.
    """
    c = _c(column)
    if n < 1:
        return F.split_part(c, F.lit("/"), F.lit(n))
    has_part = F.length(F.substring_index(c, "/", n - 1)) < F.length(c)
    if n == 1:
        has_part = F.lit(True)
    return F.when(has_part, F.substring_index(F.substring_index(c, "/", n), "/", -1)).otherwise(F.lit(""))


def dept(column="file_path") -> Column:
    """Department = fourth part of ``/S/Shared/<Dept>/...``."""
    return path_part(4, column)


def path_prefix(n: int, column="file_path") -> Column:
    """First ``n`` '/'-separated parts joined back with '/'."""
    return F.substring_index(_c(column), "/", n)


def path_depth(column="file_path") -> Column:
    """Number of '/'-separated parts (leading and trailing '' included)."""
    c = _c(column)
    return (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) + 1).cast("int")


def half_even_round(column, digits: int = 2) -> Column:
    """Round a double half-to-even on its binary value (``rint(x*10^d)/10^d``)."""
    scale = float(10**digits)
    return F.rint(_c(column) * scale) / scale


def pct(numerator, denominator, digits: int | None = 2) -> Column:
    """``100.0 * num / den`` as double; NULL when ``den`` is 0; rounded if ``digits``."""
    raw = F.try_divide(F.lit(100.0) * _c(numerator), _c(denominator))
    return raw if digits is None else half_even_round(raw, digits)


def human_size(column) -> Column:
    """IEC size text with two decimals: ``0.00 B``, ``1.50 KiB``, ``1000.71 GiB``."""
    v = _c(column).cast("double")
    chain = None
    for i, unit in enumerate(IEC_UNITS):
        scaled = v / float(1024**i)
        text = F.format_string("%.2f %s", half_even_round(scaled, 2), F.lit(unit))
        if i == len(IEC_UNITS) - 1:
            chain = chain.otherwise(text)
        else:
            cond = v < float(1024 ** (i + 1))
            chain = F.when(cond, text) if chain is None else chain.when(cond, text)
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(chain)


def tib(column) -> Column:
    """Bytes as TiB (double)."""
    return _c(column) / F.lit(TIB)


def epoch_millis(column) -> Column:
    """Milliseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(column))


def ace_count(cap: int = ACE_CAP, column="acl") -> Column:
    """Semicolons in the raw ACL (proxy for ACE count), capped at ``cap``."""
    c = _c(column)
    n = F.length(c) - F.length(F.replace(c, F.lit(";"), F.lit("")))
    return F.least(n, F.lit(cap)).cast("int")


def top_folder_legacy(column="file_path") -> Column:
    """Older regex top folder (yields the share name, kept for the legacy panels)."""
    return F.regexp_extract(_c(column), LEGACY_TOP_FOLDER_RE, 1)


def parent_dir(column="file_path") -> Column:
    """Strip a trailing name segment (a no-op on paths ending in '/')."""
    return F.regexp_replace(_c(column), LAST_SEGMENT_RE, "")


def has_windows_path(column="file_uri") -> Column:
    """Whether :func:`windows_path` gives a path, without building it; NULL for a NULL URI."""
    return _c(column).rlike(WIN_URI_RE)


def windows_path(column="file_uri") -> Column:
    """``win://host/<drive>/<rest>`` → ``<drive>:\\<rest>`` with '\\' and percent-decoding.

    Slashes are turned into backslashes before decoding, '+' stays '+',
    a '%' not followed by two hex digits stays literal, paths longer than
    248 characters get the ``\\\\?\\`` prefix, and an unrecognised URI gives NULL.
    """
    c = _c(column)
    matched = has_windows_path(c)
    drive = F.regexp_extract(c, WIN_URI_RE, 1)
    rest = F.translate(F.regexp_extract(c, WIN_URI_RE, 2), "/", "\\")
    protected = F.regexp_replace(F.replace(rest, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(protected), rest)
    win = F.concat(drive, F.lit(":\\"), decoded)
    full = F.when(F.length(win) > LONG_PATH_LIMIT, F.concat(F.lit(LONG_PATH_PREFIX), win)).otherwise(win)
    return F.when(matched, full)


def source_of(column="file_uri") -> Column:
    """``win://<host>/<share>`` prefix of a URI ('' when absent)."""
    return F.regexp_extract(_c(column), SOURCE_RE, 1)
