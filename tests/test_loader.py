"""CSV input that is not as its header says, and results that are swapped in whole."""

import gzip
import os

import pytest

from crashlens.sources.io import (all_rejected, csv_headers, load_checked, load_table, load_tables_checked,
                                  write_result)
from tests.conftest import rows


def _folder(base, **files):
    path = os.path.join(base, "units")
    os.makedirs(path)
    for name, text in files.items():
        with open(os.path.join(path, f"{name}.csv"), "w") as f:
            f.write(text)
    return path


def test_files_with_another_column_order_are_aligned_by_name(spark, tmp_out):
    path = _folder(tmp_out, a="crash_id,unit_nbr,vin\n1,2,A\n", b="unit_nbr,CRASH_ID,vin\n7,900,B\n", c="crash_id,unit_nbr,vin\n3,4,C\n")
    df = load_table(spark, path)
    assert df.columns == ["crash_id", "unit_nbr", "vin"]
    assert rows(df) == [(1, 2, "A"), (3, 4, "C"), (900, 7, "B")]
    assert sorted(len(f) for f in csv_headers(spark, path).values()) == [1, 2]
    checked = load_checked(spark, path)
    assert rows(checked.good) == rows(df) and checked.rejected.count() == 0


def test_files_with_other_columns_are_refused_by_name(spark, tmp_out):
    path = _folder(tmp_out, a="crash_id,unit_nbr,vin\n1,2,A\n", b="crash_id,unit_nbr\n3,4\n", c="crash_id,unit_nbr,vin,colour\n5,6,C,RED\n")
    with pytest.raises(ValueError, match=r"b\.csv: no column vin"):
        load_table(spark, path)
    with pytest.raises(ValueError, match=r"c\.csv: unexpected column colour"):
        load_table(spark, os.path.join(path, "[ac].csv"))
    df = load_table(spark, path, missing_columns="null")
    assert df.columns == ["crash_id", "unit_nbr", "vin", "colour"]
    assert rows(df) == [(1, 2, "A", None), (3, 4, None, None), (5, 6, "C", "RED")]
    keyless = _folder(os.path.join(tmp_out, "k"), a="crash_id,unit_nbr\n1,2\n", b="crash_id,vin\n1,A\n")
    with pytest.raises(ValueError, match=r"b\.csv: no column unit_nbr"):
        load_table(spark, keyless, missing_columns="null")
    twice = _folder(os.path.join(tmp_out, "t"), a="crash_id,vin,VIN\n1,A,B\n")
    with pytest.raises(ValueError, match="more than once"):
        load_table(spark, twice)


RAGGED = 'crash_id,unit_nbr,vin\n1,1,A\n2,1,B,EXTRA\n3\n4,1,"open\n5,1,"x, y"\n6x,1,F\n7,1,\n'


def test_ragged_records_stop_the_job_and_are_named(spark, tmp_out):
    path = _folder(tmp_out, a=RAGGED)
    with pytest.raises(Exception, match=r"(?s)wrong number of fields.*a\.csv: (2,1,B,EXTRA|3|4,1)"):
        load_table(spark, path).collect()
    with pytest.raises(Exception, match="wrong number of fields"):  # also if no column of it is read
        load_table(spark, path).count()


def test_ragged_records_are_set_aside(spark, tmp_out):
    path = _folder(tmp_out, a=RAGGED, b="vin,crash_id,unit_nbr\nZ,8,2\nZ,9\n")
    checked = load_checked(spark, path)
    assert rows(checked.good) == [(1, 1, "A"), (5, 1, "x, y"), (7, 1, None), (8, 2, "Z")]
    found = {(os.path.basename(r.file), r.text): r.reason for r in checked.rejected.collect()}
    assert set(found) == {("a.csv", "2,1,B,EXTRA"), ("a.csv", "3"), ("a.csv", '4,1,"open'), ("a.csv", "6x,1,F"), ("b.csv", "Z,9")}
    assert found["a.csv", "6x,1,F"] == "column crash_id: not a bigint: 6x"
    inches = _folder(os.path.join(tmp_out, "in"), a='crash_id,unit_nbr,vin\n1,1,5" PIPE\n2,1,"a,"\n3,1,"say \\"x\\""\n')
    assert [r.vin for r in load_table(spark, inches).orderBy("crash_id").collect()] == ['5" PIPE', "a,", 'say "x"']
    assert "csv" not in checked.good._jdf.queryExecution().executedPlan().toString().lower().replace("a.csv", "")
    checked.release()
    assert not os.path.exists(checked.folder)


def test_records_of_several_lines(spark, tmp_out):
    path = _folder(tmp_out, a='crash_id,unit_nbr,vin\n1,1,"two\nlines"\n2,1,B\n3,1,B,C\n4,1,"a ""b"""\n')
    checked = load_checked(spark, path, options={"multiLine": "true", "escape": '"'})
    assert rows(checked.good) == [(1, 1, "two\nlines"), (2, 1, "B"), (4, 1, 'a "b"')]
    assert [r.text.strip() for r in checked.rejected.collect()] == ["3,1,B,C"]
    torn = _folder(os.path.join(tmp_out, "torn"), a='crash_id,unit_nbr,vin\n1,1,A\n', b='crash_id,unit_nbr,vin\n2,1,"open\n3,1,B\n')
    with pytest.raises(ValueError, match=r"never closed in .*b\.csv"):
        load_table(spark, torn, options={"multiLine": "true"})
    with pytest.raises(Exception, match="wrong number of fields"):
        load_table(spark, path).collect()  # line by line, the first record is torn


def test_headers_of_gzip_files_other_separators_and_empty_files(spark, tmp_out):
    path = os.path.join(tmp_out, "gz")
    os.makedirs(path)
    with gzip.open(os.path.join(path, "a.csv.gz"), "wt") as f:
        f.write('﻿crash_id;unit_nbr;"a;b"\n1;2;x\n')
    with gzip.open(os.path.join(path, "b [1].csv.gz"), "wt") as f:
        f.write('unit_nbr;"a;b";crash_id\n5;y;6\n')
    open(os.path.join(path, "empty.csv"), "w").close()
    df = load_table(spark, path, options={"sep": ";"})
    assert df.columns == ["crash_id", "unit_nbr", "a;b"] and rows(df) == [(1, 2, "x"), (6, 5, "y")]


def test_rejected_records_of_a_table_set(spark, tmp_out):
    units = _folder(tmp_out, a="crash_id,unit_nbr\n1,2\n3\n")
    other = _folder(os.path.join(tmp_out, "x"), a="crash_id\n1\n2,2\n")
    tables = load_tables_checked(spark, {"units": units, "damages": other}, {"units": ("crash_id",)})
    assert sorted((r.table, r.text) for r in all_rejected(tables).collect()) == [("damages", "2,2"), ("units", "3")]


def test_a_failed_write_leaves_the_earlier_result(spark, tmp_out):
    from pyspark.sql import functions as F
    out = os.path.join(tmp_out, "analysis_q1")
    write_result(spark.range(3), out, "parquet")
    fails = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_result(fails, out, "parquet")
    assert rows(spark.read.parquet(out)) == [(0,), (1,), (2,)]
    assert os.listdir(tmp_out) == ["analysis_q1"]
    with pytest.raises(Exception, match="no"):
        write_result(fails, os.path.join(tmp_out, "analysis_q2"), "csv")
    assert os.listdir(tmp_out) == ["analysis_q1"]
    write_result(spark.range(5), out, "parquet")
    assert spark.read.parquet(out).count() == 5 and os.listdir(tmp_out) == ["analysis_q1"]
    write_result(spark.range(2), out, "parquet", mode="append")
    assert spark.read.parquet(out).count() == 7
