import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from crashlens.plans import questions as Q
from crashlens.plans.job import run_job, stage_deduped
from crashlens.plans.tables import Incidents
from crashlens.sources.io import load_tables
from tests import incident_fixture as FX
from tests.conftest import rows


def _types(cols):
    ints = {"unit_nbr", "prsn_nbr", "tot_injry_cnt", "death_cnt"}
    return ", ".join(f"{c} {'long' if c == 'crash_id' else 'int' if c in ints else 'string'}" for c in cols)


@pytest.fixture(scope="module")
def tables(spark):
    dfs = {name: spark.createDataFrame(data, _types(cols)) for name, (cols, data) in FX.TABLES.items()}
    return Incidents.from_mapping(dfs)


@pytest.mark.parametrize("name", sorted(FX.EXPECTED))
def test_question_by_hand(tables, name):
    assert rows(getattr(Q, name)(tables)) == sorted(FX.EXPECTED[name], key=lambda r: tuple(str(x) for x in r))


def test_row_outputs(tables):
    q2 = rows(Q.q2(tables))
    assert [(r[0], r[1]) for r in q2] == [(100, 3), (102, 1)]
    q4 = Q.q4(tables)
    assert "tot_injry_cnt" in q4.columns and len(q4.columns) == len(set(c.lower() for c in q4.columns))
    # the person's counters are kept, the unit's are dropped
    assert sorted((r.crash_id, r.unit_nbr, r.death_cnt) for r in q4.collect()) == [(100, 2, 1), (103, 1, 1)]
    q9 = Q.q9(tables)
    assert q9.columns[0] == "crash_id" and q9.columns[-1] == "damaged_property"
    assert [(r.crash_id, r.unit_nbr) for r in q9.collect()] == [(103, 1), (100, 1)]


def test_q7_sorted_by_count(tables):
    got = [tuple(r) for r in Q.q7(tables).collect()]
    assert got == sorted(FX.EXPECTED["q7"], key=lambda r: (-r[2], r[0]))


def test_staged_tables_give_same_answers(spark, tables):
    staged = stage_deduped(spark, tables)
    assert staged.deduped
    for name, expected in FX.EXPECTED.items():
        assert rows(getattr(Q, name)(staged)) == sorted(expected, key=lambda r: tuple(str(x) for x in r)), name


def test_answers_do_not_depend_on_partitioning(spark, tables):
    shuffled = tables.with_tables(
        units=tables.units.repartition(5).orderBy(F.rand(3)),
        primary_person=tables.primary_person.repartition(3),
        charges=tables.charges.orderBy(F.col("charge").desc()).coalesce(1),
        damages=tables.damages.orderBy(F.col("damaged_property").desc()))
    for name in FX.EXPECTED:
        assert rows(getattr(Q, name)(shuffled)) == rows(getattr(Q, name)(tables)), name


def test_job_end_to_end_from_csv(spark, tmp_out):
    src = os.path.join(tmp_out, "in")
    os.makedirs(src)
    paths = {name: FX.write_csv(src, name) for name in FX.TABLES}
    loaded = load_tables(spark, paths)
    assert dict(loaded["units"].dtypes)["crash_id"] == "bigint"
    out = os.path.join(tmp_out, "out")
    before = {t.name for t in spark.catalog.listTables()}
    written = run_job(spark, paths, out)
    assert sorted(written) == sorted(Q.QUESTIONS)
    q1 = spark.read.option("header", True).csv(os.path.join(out, "analysis_q1"))
    assert q1.columns == ["crash_id", "count_of_males_killed"]
    assert [tuple(r) for r in q1.collect()] == [("100", "3")]
    q10 = spark.read.option("header", True).csv(os.path.join(out, "analysis_q10"))
    assert sorted(tuple(r) for r in q10.collect()) == [("FORD", "2"), ("HONDA", "1")]
    # Sorted results read back in order, part file after part file.
    for name, measure in (("q7", "count"), ("q9", "crash_id")):
        values = [int(r[measure]) for part in sorted(glob.glob(os.path.join(out, f"analysis_{name}", "part-*")))
                  for r in csv.DictReader(open(part, newline=""))]
        assert values and values == sorted(values, reverse=True)
    assert {t.name for t in spark.catalog.listTables()} == before
    # Path patterns, another output format, and a missing column.
    patterns = {name: os.path.join(src, f"{name}*.csv") for name in paths}
    again = run_job(spark, patterns, os.path.join(tmp_out, "pq"), out_fmt="parquet")
    assert [tuple(r) for r in spark.read.parquet(again["q1"]).collect()] == [(100, 3)]
    with open(paths["damages"]) as f:
        text = f.read()
    with open(paths["damages"], "w") as f:
        f.write(text.replace("DAMAGED_PROPERTY", "DAMAGED"))
    with pytest.raises(ValueError, match="'damages' has no column damaged_property"):
        run_job(spark, paths, out)


def test_match_modes_and_options(tables):
    assert rows(Q.q10(tables, charge_match="any")) == [("FORD", 3), ("HONDA", 1)]
    assert rows(Q.q9_count(tables, damage_match="any")) == [(3,)]
    assert sorted(r.crash_id for r in Q.q9(tables, damage_match="any").collect()) == [100, 101, 103]
    assert [tuple(r) for r in Q.q5(tables, k=5).collect()] == [("Texas", 2), ("NA", 1)]
    assert [tuple(r) for r in Q.q5(tables, k=5, placeholders=("NA",)).collect()] == [("Texas", 2)]
    assert rows(Q.q8(tables, body_style="CAR")) == [("90001", 1)]
    with pytest.raises(ValueError):
        Q.q10(tables, charge_match="some")
    with pytest.raises(ValueError):
        Q.q10(tables.with_tables(deduped=True), charge_match="any")


def test_profile_job(spark, tables, tmp_out):
    from crashlens.plans.profile_job import profile_tables, write_profiles
    dfs = {"units": tables.units, "primary_person": tables.primary_person, "charges": tables.charges,
           "damages": tables.damages, "endorse": tables.endorse, "restrict": tables.restrict}
    prof = profile_tables(spark, dfs)
    u = prof["units_profile"].collect()[0]
    assert (u.n_rows, u.n_distinct_rows, u.n_keys, u.n_missing) == (9, 9, 8, 0)
    c = prof["charges_profile"].collect()[0]
    assert (c.n_rows, c.n_keys) == (7, 6)
    d = prof["damages_profile"].collect()[0]
    assert (d.n_rows, d.n_keys) == (4, 3)
    assert prof["units_vehicle_count"].collect()[0].n == 7
    k = prof["units_key_counts"].collect()[0]
    assert (k.n_rows, k.n_keys_crash_id_unit_nbr,
            k.n_keys_veh_lic_state_id_vin_veh_mod_year_veh_make_id) == (9, 8, 7)
    vals = {(r.column, r.value): r.n for r in prof["units_values"].collect()}
    assert vals[("veh_make_id", "FORD")] == 3 and vals[("death_cnt", "1")] == 2
    assert [r.unit_nbr for r in prof["units_largest_unit_nbr"].collect()] == [3, 2, 1]
    assert prof["units_missing"].collect()[0].n_missing_veh_mod_year == 1
    written = write_profiles(prof, tmp_out)
    assert len(written) == len(prof)


def test_profile_job_from_csv(spark, tmp_out):
    from crashlens.plans.profile_job import run_profile
    src = os.path.join(tmp_out, "in")
    os.makedirs(src)
    paths = {name: FX.write_csv(src, name) for name in FX.TABLES}
    written = run_profile(spark, paths, os.path.join(tmp_out, "prof"))
    assert "units_profile" in written and "endorse_values" in written and "damages_preview" in written
    prof = spark.read.option("header", True).csv(written["units_profile"]).collect()[0]
    assert (prof.n_rows, prof.n_keys) == ("9", "8")
