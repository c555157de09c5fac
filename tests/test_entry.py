"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "p1_found" in queries and set(sql) <= set(queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "entity_id", "piece", "start_ms", "end_ms"] and df.count() > 0
