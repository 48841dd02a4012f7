"""Every registered query against its DuckDB SQL twin on the smallest test tables."""

import os

import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def report(spark):
    from crashlens.plans.registry import QUERIES
    from tools.oracle_check import compare
    return compare(spark, SF_SMALL, sorted(QUERIES))


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from crashlens.plans.oracle_sql import ORACLE_SQL
    from crashlens.plans.registry import QUERIES
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_works_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(top, "crashlens"), tmp_path / "crashlens",
                    ignore=lambda d, names: {n for n in names if n in ("llm", "__pycache__")})
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"],
                         cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == out[1] and int(out[0]) >= 43


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["veh_make_id", "count"]
    assert len(df.collect()) == 5


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables missing")
def test_spark_equals_duckdb(report):
    bad = {k: v for k, v in report.items()
           if not (v["values_equal"] and v["columns_equal"] and v["types_equal"]
                   and v["rows"] == v["oracle_rows"])}
    assert bad == {}
