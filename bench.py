"""Benchmark: the run-all job over the incident views of the test tables.

Stages the four deduped tables once (bucketed parquet in the checkpoint folder), then
answers and writes the ten questions as CSV, as the surveyed job does, four questions at a
time (as ``run_job`` does). Prints one JSON line: total wall seconds (stage + ten
questions), the stage time, each question's own latency, and the questions' wall time.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_CONCURRENCY (questions at a time, default 4; 1 gives clean per-question times).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crashlens.plans.job import run_question, stage_deduped  # noqa: E402
from crashlens.plans.questions import QUESTIONS  # noqa: E402
from crashlens.session import build_session  # noqa: E402
from crashlens.sources.sample_views import sample_incidents  # noqa: E402

CONCURRENCY = int(os.environ.get("BENCH_CONCURRENCY", "4"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app_name="crashlens-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "8g"})
    out_dir = tempfile.mkdtemp(prefix="crashlens-bench-")
    times: dict[str, float] = {}  # filled from the question threads, one key each

    t0 = time.perf_counter()
    staged = stage_deduped(spark, sample_incidents(spark, sf_dir))
    times["stage"] = round(time.perf_counter() - t0, 3)

    def timed(name: str) -> None:
        t0 = time.perf_counter()
        run_question(staged, name, out_dir, "csv")
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    with ThreadPoolExecutor(max_workers=CONCURRENCY) as pool:
        list(pool.map(timed, list(QUESTIONS)))
    times["questions_wall"] = round(time.perf_counter() - t0, 3)

    total = round(times["stage"] + times["questions_wall"], 3)
    order = ["stage", *QUESTIONS, "questions_wall"]
    times = {k: times[k] for k in order}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "stage_plus_ten_questions", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus,
                      "concurrent_questions": CONCURRENCY}))
    spark.stop()


if __name__ == "__main__":
    main()
