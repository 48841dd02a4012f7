"""The training-data queries that have a DuckDB twin, against it."""

from crashlens.llm.oracle_sql import ORACLE_SQL
from crashlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_spark_equals_duckdb(spark):
    from tools.oracle_check import compare
    assert set(ORACLE_SQL) <= set(QUERIES)
    report = compare(spark, SF_SMALL, sorted(ORACLE_SQL))
    bad = {k: v for k, v in report.items()
           if not (v["values_equal"] and v["columns_equal"] and v["types_equal"] and v["rows"] == v["oracle_rows"])}
    assert bad == {}


def test_one_query_per_operator():
    import __spark_entry__ as E
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(E.queries())
