"""Structured Streaming monitors and the probe loader."""

from invlens.streaming.monitor import (
    distinct_probes,
    inventory_stream,
    inventory_totals,
    load_probe_stream,
    monitor_inventory,
    monitor_probes,
    probe_completion,
    start_monitor,
    with_progress,
)

__all__ = [
    "distinct_probes",
    "inventory_stream",
    "inventory_totals",
    "load_probe_stream",
    "monitor_inventory",
    "monitor_probes",
    "probe_completion",
    "start_monitor",
    "with_progress",
]
