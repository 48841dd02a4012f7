"""The run-all job goes on where an earlier run stopped, and a failing question stops no other."""

import os

import pytest

from crashlens.plans import job
from crashlens.plans import questions as Q
from crashlens.session import staging_path
from tests import incident_fixture as FX
from tests.conftest import rows


@pytest.fixture
def inputs(tmp_out):
    src = os.path.join(tmp_out, "in")
    os.makedirs(src)
    return {name: FX.write_csv(src, name) for name in FX.TABLES}


def _tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def _answers(spark, out):
    return {n: rows(spark.read.parquet(os.path.join(out, f"analysis_{n}"))) for n in Q.QUESTIONS}


@pytest.mark.parametrize("concurrency", [1, 4])
def test_a_failing_question_stops_no_other_and_only_it_is_answered_again(spark, inputs, tmp_out, monkeypatch, concurrency):
    out, before = os.path.join(tmp_out, "out"), _tables(spark)
    asked, staged = [], []
    real, real_stage = job.run_question, job.Incidents.units_by_key

    def broken(t, name, *args):
        asked.append(name)
        if name in ("q3", "q8"):
            raise RuntimeError(f"injected in {name}")
        return real(t, name, *args)

    monkeypatch.setattr(job, "run_question", broken)
    monkeypatch.setattr(job.Incidents, "units_by_key", lambda t: (staged.append(t.deduped), real_stage(t))[1])
    with pytest.raises(job.JobError, match="failed: q3: injected in q3; q8: injected in q8") as e:
        job.run_job(spark, inputs, out, out_fmt="parquet", concurrency=concurrency)
    assert sorted(asked) == sorted(Q.QUESTIONS) and sorted(e.value.failed) == ["q3", "q8"]
    assert sorted(e.value.written) == sorted(set(Q.QUESTIONS) - {"q3", "q8"})
    assert _tables(spark) == before
    assert staged.count(False) == 1
    asked.clear(), staged.clear()
    monkeypatch.setattr(job, "run_question", lambda t, name, *args: (asked.append(name), real(t, name, *args))[1])
    written = job.run_job(spark, inputs, out, out_fmt="parquet", concurrency=concurrency)
    assert sorted(asked) == ["q3", "q8"] and sorted(written) == sorted(Q.QUESTIONS)
    assert False not in staged  # the deduped tables were taken up
    folder = staging_path(spark, "run-" + job.input_signature(spark, inputs, "csv", "error"))
    assert not os.path.exists(folder.removeprefix("file:")) and _tables(spark) == before
    fresh = os.path.join(tmp_out, "fresh")
    job.run_job(spark, inputs, fresh, out_fmt="parquet")
    assert _answers(spark, out) == _answers(spark, fresh)


def test_a_lost_driver_leaves_no_table_and_its_whole_steps_are_taken_up(spark, inputs, tmp_out, monkeypatch):
    out, before = os.path.join(tmp_out, "out"), _tables(spark)
    real = job.run_question
    asked = []

    class Lost(BaseException):
        pass

    def seven(t, name, *args):
        if len(asked) == 7:
            raise Lost
        asked.append(name)
        return real(t, name, *args)

    monkeypatch.setattr(job, "run_question", seven)
    with pytest.raises(job.JobError):
        job.run_job(spark, inputs, out, out_fmt="parquet", concurrency=1)
    assert len(asked) == 7 and _tables(spark) == before
    folder = staging_path(spark, "run-" + job.input_signature(spark, inputs, "csv", "error")).removeprefix("file:")
    os.remove(os.path.join(folder, "notes", "table-charges.json"))  # as if cut off while this table was written
    asked.clear()
    monkeypatch.setattr(job, "run_question", lambda t, name, *args: (asked.append(name), real(t, name, *args))[1])
    job.run_job(spark, inputs, out, out_fmt="parquet")
    assert len(asked) == 3
    fresh = os.path.join(tmp_out, "fresh")
    job.run_job(spark, inputs, fresh, out_fmt="parquet", resume=False)
    assert _answers(spark, out) == _answers(spark, fresh)


def test_other_inputs_are_another_run(spark, inputs):
    one = job.input_signature(spark, inputs, "csv")
    assert one == job.input_signature(spark, inputs, "csv") != job.input_signature(spark, inputs, "parquet")
    with open(inputs["charges"], "a") as f:
        f.write("\n")
    assert job.input_signature(spark, inputs, "csv") != one


def test_quarantined_records_reach_no_question(spark, inputs, tmp_out):
    clean = os.path.join(tmp_out, "clean")
    job.run_job(spark, inputs, clean, out_fmt="parquet")
    with open(inputs["damages"], "a") as f:
        f.write("100,FENCE,EXTRA,FIELD,MORE\nx9,FENCE\n")
    with pytest.raises(Exception, match="wrong number of fields|not a bigint"):
        job.run_job(spark, inputs, os.path.join(tmp_out, "bad"), out_fmt="parquet")
    out = os.path.join(tmp_out, "out")
    written = job.run_job(spark, inputs, out, out_fmt="parquet", bad_rows="quarantine")
    rejected = spark.read.parquet(written["rejected_rows"]).collect()
    assert {(r.table, r.text) for r in rejected} == {("damages", "100,FENCE,EXTRA,FIELD,MORE"), ("damages", "x9,FENCE")}
    assert _answers(spark, out) == _answers(spark, clean)
