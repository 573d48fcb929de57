"""The driver's contract."""

import __spark_entry__ as entry
from quillmill.plans import registry


def test_names_and_twins():
    known, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(known) and set(registry.QUERIES) <= set(known)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "uplift_pct" in rows.columns
