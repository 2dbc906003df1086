import __spark_entry__ as entry
from tests.oracle_check import compare, sql_connection


def test_each_operator_has_one_query():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert {x for x in entry.oracle_sql() if x.startswith("op")} <= set(names)


def test_sql_of_near_duplicates_and_substrings(spark, sf):
    con, sql = sql_connection(sf), entry.oracle_sql()
    for name in ("op4_near_duplicates", "op10_substrings"):
        assert compare(spark, con, name, entry.queries()[name], sql[name], sf) is None
