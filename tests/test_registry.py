import __spark_entry__ as e


def test_sql_only_for_known_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "summary_by_system" in e.queries()
