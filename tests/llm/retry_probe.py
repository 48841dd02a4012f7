"""Run a staged operator and an Arrow one with every first attempt over the documents failing on
purpose, and print their rows as JSON beside those of an undisturbed run. Used by
test_llm_retry.py."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from crashlens.llm import embedding_dedup, minhash_dedup, queries, window_packing  # noqa: E402


@F.udf(T.LongType())
def fail_first_attempt(x):
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return x


def rows(df) -> list:
    return sorted((list(map(str, r)) for r in df.collect()), key=str)


def main() -> None:
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crashlens-retry-"))
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    words = [f"w{i % 97}" for i in range(400)]
    texts = [(i, " ".join(words[i % 7: i % 7 + 60 + i % 3])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    vectors = spark.createDataFrame([(i, [1.0, i % 5 / 2, i % 3 / 9]) for i in range(60)],
                                    "vec_id long, embedding array<double>").repartition(3)
    runs = {
        "minhash": lambda d, v: minhash_dedup.near_duplicates(d, k=4),
        "packing": lambda d, v: window_packing.pack_documents(d, queries.tokenizer_path("byte_bpe_50k.json"))
        .select("doc_id", "start", "length", F.crc32("ids")),
        "vectors": lambda d, v: embedding_dedup.near_vectors(v),
    }
    calm = {name: rows(run(docs, vectors)) for name, run in runs.items()}
    shaky_docs = docs.withColumn("doc_id", fail_first_attempt("doc_id"))
    shaky_vectors = vectors.withColumn("vec_id", fail_first_attempt("vec_id"))
    spark.sparkContext.setJobGroup("retry-probe", "operators with injected task failures")
    shaken = {name: rows(run(shaky_docs, shaky_vectors)) for name, run in runs.items()}
    tracker, failed = spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup("retry-probe"):
        info = tracker.getJobInfo(job)
        for stage in (info.stageIds if info else []):
            st = tracker.getStageInfo(stage)
            failed += st.numFailedTasks if st else 0
    print("FAILED_TASKS " + str(failed))
    print("ROWS " + json.dumps({name: [calm[name], shaken[name]] for name in runs}))
    spark.stop()


if __name__ == "__main__":
    main()
