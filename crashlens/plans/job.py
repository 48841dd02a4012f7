"""Run-all job: dedup the four question tables once, then answer and write the ten questions.

The deduped tables are written as bucketed parquet tables in the shared checkpoint folder
(``spark.checkpoint.dir``). That cuts the lineage (a lost executor re-reads files instead
of recomputing scans, joins and dedups) and keeps the tables hash-bucketed on their keys,
so the Units-Person joins of the questions read co-located buckets without a shuffle.

A run leaves a note of each finished step in its folder. Started again over the same inputs after
a failure or a lost driver, it takes up the staged tables and finished questions it finds there.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from crashlens.plans.questions import QUESTIONS
from crashlens.plans.tables import Incidents
from crashlens.session import apply_scale_conf, input_bytes, partitions_for, staging_path
from crashlens.sources.io import (all_rejected, delete_path, load_tables, load_tables_checked, result_path,
                                  write_result)
from crashlens.sources.schemas import (CHARGE_KEY, CHARGES, DAMAGE_KEY, DAMAGES, PERSON,
                                       QUESTION_COLUMNS, UNIT_KEY, UNITS)


def _hadoop(spark: SparkSession, place: str):
    """File system and path of a place that the cluster shares."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Notes:
    """Which steps of a run are finished: one small file a step, in the run's shared folder.

    A note is written whole and then renamed, after the step's own files are complete, so a
    step that was cut off has none.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, step: str) -> dict | None:
        fs, path = _hadoop(self.spark, f"{self.folder}/notes/{step}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, step: str, **what) -> None:
        fs, path = _hadoop(self.spark, f"{self.folder}/notes/{step}.json")
        _, fresh = _hadoop(self.spark, f"{self.folder}/notes/.{step}-{uuid.uuid4().hex}")
        stream = fs.create(fresh)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        fs.delete(path, False)
        if not fs.rename(fresh, path):
            raise OSError(f"cannot note {step} as finished")


class JobError(RuntimeError):
    """Questions that failed, by name; the others were answered."""

    def __init__(self, failed: Mapping[str, BaseException], written: Mapping[str, str]):
        super().__init__("failed: " + "; ".join(f"{name}: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}"
                                                for name, e in failed.items()))
        self.failed, self.written = dict(failed), dict(written)


def _open_bucketed(spark: SparkSession, table: str, place: str, schema: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """Bucketed files as a catalog table; its columns and files are looked up here, once."""
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS "
              f"LOCATION '{place}'")
    return spark.table(table)


def _stage(spark: SparkSession, make: Callable[[], DataFrame], keys: tuple[str, ...], buckets: int,
           folder: str, name: str, catalog: bool) -> tuple[str, DataFrame]:
    """The table of :func:`stage_deduped`, taken up if the folder holds it whole."""
    notes, place = Notes(spark, folder), os.path.join(folder, name)
    table = f"crashlens_{name}_{uuid.uuid4().hex[:12]}"
    done = notes.get(f"table-{name}")
    if done is None:
        df = make()
        delete_path(spark, place)  # of a write that was cut off
        # No sortBy: bucketed scans do not report a sort order, so the join sorts anyway and
        # a write-side sort would only cost time.
        try:
            df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).option("path", place).saveAsTable(table)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
        done = {"schema": columns, "buckets": buckets}
        notes.put(f"table-{name}", **done)
    try:
        return table, _open_bucketed(spark, table, place, done["schema"], keys, done["buckets"])
    finally:
        if not catalog:  # what was looked up stays readable without the entry
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def stage_deduped(spark: SparkSession, t: Incidents, folder: str | None = None,
                  buckets: Mapping[str, int] | None = None, catalog: bool = True) -> Incidents:
    """Write Units, Person, Charges and Damages one row per key, bucketed on that key.

    ``folder`` defaults to a new sub-folder of the shared checkpoint folder. ``buckets`` gives
    a table's bucket count (``spark.sql.shuffle.partitions`` for one not listed), so that a
    narrow table is not cut into as many files as a wide one. Units and Person share the key
    and get the larger of their two counts, which is what makes their join co-located.
    A ``folder`` that already holds a whole table from an earlier run gives that one. The
    result's ``staged`` names the folder and the catalog tables; :func:`release` drops them.
    ``catalog=False`` drops the tables as soon as they are looked up (their files stay), so that
    a driver that is lost leaves none behind.
    """
    folder = folder or staging_path(spark, uuid.uuid4().hex)
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = {name: (buckets or {}).get(name, default) for name in (UNITS, PERSON, CHARGES, DAMAGES)}
    count[UNITS] = count[PERSON] = max(count[UNITS], count[PERSON])
    jobs = {"units": (t.units_by_key, UNIT_KEY), "primary_person": (t.persons_by_key, UNIT_KEY)}
    if t.charges is not None:
        jobs["charges"] = (t.charges_by_key, CHARGE_KEY)
    if t.damages is not None:
        jobs["damages"] = (t.damages_by_key, DAMAGE_KEY)
    # The four writes are independent Spark jobs; submitted together they share the
    # executors instead of leaving cores idle at each job's tail.
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {name: pool.submit(_stage, spark, fn, keys, count[name], folder, name, catalog)
                   for name, (fn, keys) in jobs.items()}
        staged = {name: f.result() for name, f in futures.items()}
    return t.with_tables(deduped=True, staged=(folder, tuple(table for table, _ in staged.values()) if catalog else ()),
                         **{name: df for name, (_, df) in staged.items()})


def release(spark: SparkSession, t: Incidents) -> None:
    """Drop the catalog tables of :func:`stage_deduped` and delete their folder."""
    if t.staged is None:
        return
    folder, tables = t.staged
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    delete_path(spark, folder)


def run_question(t: Incidents, name: str, out_dir: str, fmt: str = "csv") -> str:
    """Answer and write one question (one action)."""
    return write_result(QUESTIONS[name](t), result_path(out_dir, f"analysis_{name}"), fmt)


def run_questions(t: Incidents, out_dir: str, fmt: str = "csv", names: list[str] | None = None,
                  concurrency: int = 4, notes: Notes | None = None) -> dict[str, str]:
    """Answer and write each question once.

    The questions are independent Spark jobs; up to ``concurrency`` of them are submitted
    at a time, so the short final stages of one question overlap with the work of another
    instead of leaving executors idle. ``concurrency=1`` runs them one after another. A question
    that fails stops no other; in the end a :class:`JobError` names each that failed. With
    ``notes``, questions noted as finished are not answered again while their result is there.
    """
    names = names or list(QUESTIONS)
    spark = t.units.sparkSession

    def answer(name: str) -> str:
        step = f"question-{name}"
        done = notes.get(step) if notes else None
        if done is not None:
            fs, path = _hadoop(spark, done["path"])
            if done["path"] == result_path(out_dir, f"analysis_{name}") and done["fmt"] == fmt and fs.exists(path):
                return done["path"]
        path = run_question(t, name, out_dir, fmt)
        if notes:
            notes.put(step, path=path, fmt=fmt)
        return path

    written: dict[str, str] = {}
    failed: dict[str, BaseException] = {}
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        futures = {name: pool.submit(answer, name) for name in names}
    for name, f in futures.items():
        if f.exception() is None:
            written[name] = f.result()
        else:
            failed[name] = f.exception()
    if failed:
        raise JobError(failed, written)
    return written


def input_signature(spark: SparkSession, paths: Mapping[str, str], *more: str) -> str:
    """A digest of what a job reads: each input's files with size and time of change, and
    ``more``. A run is taken up only over the same inputs."""
    h = hashlib.sha256(json.dumps(more).encode())
    for name, place in sorted(paths.items()):
        fs, path = _hadoop(spark, place)
        files = []
        for status in fs.globStatus(path) or ():
            if status.isFile():
                files.append(status)
            else:
                listing = fs.listFiles(status.getPath(), True)
                while listing.hasNext():
                    files.append(listing.next())
        h.update(json.dumps([name, sorted([f.getPath().toString(), f.getLen(), f.getModificationTime()] for f in files)]).encode())
    return h.hexdigest()[:32]


def run_job(spark: SparkSession, paths: dict[str, str], out_dir: str, in_fmt: str = "csv",
            out_fmt: str = "csv", stage: bool = True, bad_rows: str = "error", resume: bool = True,
            concurrency: int = 4) -> dict[str, str]:
    """Load the six tables, stage the deduped ones, answer and write all ten questions.

    Shuffle partitions, split sizes and bucket counts follow the input size unless set
    explicitly. Paths may be patterns. A table without a column that a question reads stops
    the job before any question runs. CSV records that do not fit their header stop it too, with
    file and record, or with ``bad_rows="quarantine"`` are written to ``<out_dir>/rejected_rows``
    (``table, file, reason, text``; returned under that name) and reach no question.

    Staged tables and notes of finished steps stand in a folder named by the inputs. They are
    deleted once all questions are answered; after a failure or a lost driver the next run over the
    same inputs goes on from there (``resume=False`` starts anew).
    """
    if bad_rows not in ("error", "quarantine"):
        raise ValueError(f"bad_rows must be 'error' or 'quarantine', not {bad_rows!r}")
    if bad_rows == "quarantine" and (in_fmt != "csv" or not stage):
        raise ValueError("bad_rows='quarantine' is for staged runs over CSV")
    apply_scale_conf(spark, list(paths.values()))
    if not stage:
        t = Incidents.from_mapping(load_tables(spark, paths, in_fmt, required=QUESTION_COLUMNS))
        return run_questions(t, out_dir, out_fmt, concurrency=concurrency)
    folder = staging_path(spark, "run-" + input_signature(spark, paths, in_fmt, bad_rows))
    if not resume:
        delete_path(spark, folder)
    notes = Notes(spark, folder)
    written: dict[str, str] = {}
    checked = {}
    if bad_rows == "quarantine":
        rejected = result_path(out_dir, "rejected_rows")
        checked = load_tables_checked(spark, paths, required=QUESTION_COLUMNS)
        t = Incidents.from_mapping({name: c.good for name, c in checked.items()})
        written["rejected_rows"] = write_result(all_rejected(checked), rejected, out_fmt)
    else:
        t = Incidents.from_mapping(load_tables(spark, paths, in_fmt, required=QUESTION_COLUMNS))
    cores = spark.sparkContext.defaultParallelism
    try:
        staged = stage_deduped(spark, t, folder, catalog=False, buckets={
            name: partitions_for(input_bytes(spark, [path]), cores) for name, path in paths.items()})
    finally:
        for c in checked.values():
            c.release()
    written.update(run_questions(staged, out_dir, out_fmt, concurrency=concurrency, notes=notes))
    release(spark, staged)
    return written


def main(argv: list[str] | None = None) -> None:
    """``[profile|quarantine] OUT_DIR IN_FORMAT[:OUT_FORMAT] name=path ...``: answer the ten
    questions; with ``profile`` first, write the table checks instead, with ``quarantine`` first,
    set aside records that do not fit. The output format is CSV unless given."""
    import sys

    from crashlens.plans.profile_job import run_profile
    from crashlens.session import build_session

    args = list(sys.argv[1:] if argv is None else argv)
    profile = bool(args) and args[0] == "profile"
    quarantine = bool(args) and args[0] == "quarantine"
    if profile or quarantine:
        args = args[1:]
    out_dir, fmt, pairs = args[0], args[1], args[2:]
    in_fmt, _, out_fmt = fmt.partition(":")
    paths = dict(p.split("=", 1) for p in pairs)
    spark = build_session()
    try:
        more = {"bad_rows": "quarantine"} if quarantine else {}
        run = run_profile if profile else run_job
        for name, path in run(spark, paths, out_dir, in_fmt=in_fmt, out_fmt=out_fmt or "csv", **more).items():
            rejected = name == "rejected_rows"
            print(name, path, *([spark.read.format(out_fmt or "csv").load(path).count(), "records"] if rejected else []))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
