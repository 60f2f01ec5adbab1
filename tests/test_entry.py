import os

import __spark_entry__ as E


def test_oracles_cover_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_entry_smoke(spark):
    assert os.path.isdir(E.SMOKE_DIR), f"test data missing: {E.SMOKE_DIR}"
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"path", "n_versions", "changed_lines", "large_changes", "max_effective_loc"}
