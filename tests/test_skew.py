"""A key holding a third of all rows must be reduced inside the map tasks, before the shuffle.

The checks read the shuffle metrics of the executed plan: the number of records written by
each exchange must stay near the number of distinct keys, not the number of input rows.
"""

from pyspark.sql import functions as F

from crashlens.functions.predicates import ieq
from crashlens.operators.dedup import count_entities, dedup_by_key
from crashlens.operators.groups import groups_without
from crashlens.plans import questions as Q
from crashlens.plans.tables import Incidents

ROWS = 60_000
MAP_TASKS = 8


def _walk(node):
    yield node
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _walk(node.executedPlan())
    elif "QueryStage" in name:
        yield from _walk(node.plan())
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def _shuffle_records(df):
    """Records written by each shuffle of ``df``'s own executed plan."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # runs this query execution, so its plan carries the metrics
    out = []
    for node in _walk(qe.executedPlan()):
        if node.nodeName() == "Exchange":
            metrics = node.metrics()
            if metrics.contains("shuffleRecordsWritten"):
                out.append(metrics.apply("shuffleRecordsWritten").value())
    assert out and min(out) > 0, f"no shuffle metrics found: {out}"
    return out


def _hot(spark):
    """A third of the rows share crash 0 / unit 0; the rest have their own key."""
    ids = spark.range(0, ROWS, numPartitions=MAP_TASKS)
    hot = F.col("id") % 3 == 0
    return ids.select(
        F.when(hot, F.lit(0)).otherwise(F.col("id")).alias("crash_id"),
        F.when(hot, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("unit_nbr"),
        (F.col("id") % 97).cast("string").alias("payload"),
        F.when(F.col("id") % 5 == 0, "FEMALE").otherwise("MALE").alias("prsn_gndr_id"),
        (F.col("id") % 7).cast("string").alias("drvr_lic_state_id"))


def test_dedup_sends_one_row_per_map_task_for_a_hot_key(spark):
    df = _hot(spark)
    distinct_keys = ROWS - ROWS // 3 + 1
    records = _shuffle_records(dedup_by_key(df, ["crash_id", "unit_nbr"]))
    assert records, "no shuffle found"
    assert max(records) <= distinct_keys + MAP_TASKS


def test_group_tests_aggregate_before_the_shuffle(spark):
    df = _hot(spark)
    records = _shuffle_records(groups_without(df, "crash_id", ieq("prsn_gndr_id", "FEMALE")))
    assert max(records) <= ROWS - ROWS // 3 + MAP_TASKS
    ent = _shuffle_records(count_entities(df, ["crash_id", "unit_nbr"]))
    assert max(ent) <= ROWS - ROWS // 3 + MAP_TASKS


def test_q5_hot_crash_is_reduced_before_the_crash_window(spark):
    persons = _hot(spark).withColumn("prsn_nbr", F.lit(1))
    t = Incidents(units=persons, primary_person=persons, deduped=True)
    records = _shuffle_records(Q.q5(t))
    # the hot crash reaches the crash-level window as at most one row per state per map task
    assert max(records) <= ROWS - ROWS // 3 + 7 * MAP_TASKS


def test_q10_dedups_units_once(spark):
    """Q10 uses the deduped Units three times (two rankings and the join); the rankings and
    the join share one dedup shuffle, so only two unit-key shuffles carry rows: Units and
    Person (the rows without a key are deduped apart, and the test tables have none)."""
    from crashlens.sources.sample_views import sample_incidents
    from tests.conftest import SF_SMALL
    df = Q.q10(sample_incidents(spark, SF_SMALL))
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    loaded = []
    for node in _walk(qe.executedPlan()):
        if node.nodeName() != "Exchange":
            continue
        part = node.outputPartitioning().toString()
        if part.startswith("hashpartitioning(crash_id") and "prsn_nbr" not in part:
            written = node.metrics().apply("shuffleRecordsWritten").value()
            if written > 0:
                loaded.append(written)
    assert len(loaded) == 2, loaded
