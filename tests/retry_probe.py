"""Run the fixture questions in a session that retries failed tasks, with the first attempt of
every map task over Units failing on purpose, directly and over staged tables; print the
answers as JSON. Used by test_retry.py."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from crashlens.plans import questions as Q  # noqa: E402
from crashlens.plans.job import stage_deduped  # noqa: E402
from crashlens.plans.tables import Incidents  # noqa: E402
from tests import incident_fixture as FX  # noqa: E402
from tests.test_questions import _types  # noqa: E402


@F.udf(T.LongType())
def fail_first_attempt(x):
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return x


def main() -> None:
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    dfs = {name: spark.createDataFrame(data, _types(cols)) for name, (cols, data) in FX.TABLES.items()}
    dfs["units"] = dfs["units"].repartition(3).withColumn("crash_id", fail_first_attempt("crash_id"))
    t = Incidents.from_mapping(dfs)
    sc = spark.sparkContext
    sc.setJobGroup("retry-probe", "questions with injected task failures")
    out = {name: sorted([list(r) for r in getattr(Q, name)(t).collect()], key=str) for name in FX.EXPECTED}
    staged = stage_deduped(spark, t)  # the bucketed writes see the failures too
    out_staged = {name: sorted([list(r) for r in getattr(Q, name)(staged).collect()], key=str)
                  for name in FX.EXPECTED}
    tracker = sc.statusTracker()
    failed = 0
    for job in tracker.getJobIdsForGroup("retry-probe"):
        info = tracker.getJobInfo(job)
        for stage in (info.stageIds if info else []):
            st = tracker.getStageInfo(stage)
            failed += st.numFailedTasks if st else 0
    print("FAILED_TASKS " + str(failed))
    print("ANSWERS " + json.dumps(out))
    print("STAGED " + json.dumps(out_staged))
    spark.stop()


if __name__ == "__main__":
    main()
