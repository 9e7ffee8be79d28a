"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["files"] > 0
    assert df.columns == ["logical_bytes", "on_disk_bytes", "probed_files", "files", "logical_capacity", "on_disk_capacity"]


def test_queries_and_oracle_keys():
    from invlens import catalog

    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert q and set(o) <= set(q) and set(catalog.queries()) == set(catalog.oracle()) <= set(o)
    assert all(callable(f) for f in q.values())
    tables = ("scan_results", "file_physical", "documents")
    assert all(isinstance(v, str) and any(t in v for t in tables) for v in catalog.oracle().values())
