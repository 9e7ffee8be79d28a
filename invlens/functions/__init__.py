"""Column builders: predicates (P*), classifiers (C*) and scalars (F*)."""

from invlens.functions.classifiers import (
    ACCESS_AGE_BANDS,
    ACCESS_AGE_REST,
    ACL_PATTERNS,
    LOG_SIZE_BUCKETS,
    LOG_SIZE_REST,
    MODIFIED_AGE_BANDS,
    MODIFIED_AGE_REST,
    SIZE_BANDS,
    SIZE_BANDS_REST,
    UNATTRIBUTABLE,
    acl_pattern,
    age_band,
    chargeback_group,
    owner_class,
    size_band,
    status,
)
from invlens.functions.predicates import (
    acl_mentions,
    has_dept,
    has_flag,
    is_dept_group,
    is_directory,
    is_encoded,
    is_file,
    is_non_ascii,
    is_orphan,
    is_service_account,
    large_and_stale,
    naive_broken,
    newer_than,
    size_over,
    stale,
    year_between,
    year_is,
)
from invlens.functions.scalars import (
    ace_count,
    dept,
    epoch_millis,
    half_even_round,
    has_windows_path,
    human_size,
    parent_dir,
    path_depth,
    path_part,
    path_prefix,
    pct,
    source_of,
    tib,
    top_folder_legacy,
    windows_path,
)
from invlens.functions.timeutil import as_of_literal, days_before, minus, years_before

__all__ = [n for n in dir() if not n.startswith("_")]
