"""A training-corpus pipeline: five stages, each one of the operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; the last returns packed pieces. A stage works on all rows that came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import (language_id, language_reject, minhash_dedup, secret_forest, toxicity_grammar,
                           window_packing)
from crashlens.llm.common import Staging, read_table
from crashlens.llm.queries import tokenizer_path

#: A text goes if the probability that it is toxic is this high.
TOXIC = 0.5
#: A text goes if no language can be told, or none has this mean probability.
LANGUAGE_SCORE = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic by the clause grammar (operator 8) go. The grammar is learned
    from the labelled documents."""
    grammar = toxicity_grammar.learn_grammar(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity_grammar.score_toxicity(docs, grammar, score_col="__score", channels_col="__channels")
    return scored.where(F.col("__score") < TOXIC).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language the network (operator 1) cannot tell, or whose
    letter pairs are those of no labelled language (junk, languages not learned), go."""
    found = language_id.identify_language(docs, language_id.learn_languages(docs), lang_col="__lang", score_col="__score")
    known = language_reject.learn_letter_pairs(docs)
    return (found.where((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__score") >= LANGUAGE_SCORE))
            .where(language_reject.in_learned_language(F.col("text"), known))
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (operator 3; five-word shingles, similarity 0.8) the row with
    the smallest id stays (null ids last; of several rows of that id the one with the smallest
    text digest).

    Rows are numbered first and grouped by that number, since an id may recur: two equal rows
    are copies, and a unique text is not lost to another text under its id.
    """
    staging = Staging(spark, "numbered")
    rows = staging.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = minhash_dedup.near_duplicates(rows, k=5, percent=80, id_col="__row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "__row"))
    keys = rows.select("__row", "doc_id", F.md5("text").alias("digest")).join(
        groups.select(F.col("doc_id").alias("row"), "component_id"), F.col("__row") == F.col("row"))
    kept = keys.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("kept_row"))
    return rows.join(kept, rows["__row"] == kept["kept_row"], "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by the forest (operator 10) are replaced; every document stays."""
    clean = secret_forest.redact_secrets(docs, path_col="source")
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(
        F.char_length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as pieces of token windows (operator 6)."""
    return window_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates),
          ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage, from the table ``documents``."""
    staging = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
