"""DataFrame operators: latest-wins, exact quantiles, shares, top-k, joins, comparison."""

from invlens.operators.aggregates import (
    age_matrix,
    exact_quantiles,
    latest_physical,
    running_total,
    top_k,
    total_of,
    with_share,
)
from invlens.operators.compare import compare_reports, compare_runs, reconcile, unpivot_metrics
from invlens.operators.joins import capacity, missing_probes, orphan_probes, with_physical

__all__ = [n for n in dir() if not n.startswith("_")]
