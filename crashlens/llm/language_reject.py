"""Texts in none of the learned languages: the reject class beside operator 1.

A network that knows four languages gives each text one of them, keyboard junk and other
scripts too. Here a text is measured by the share of its neighbouring letter pairs that are
usual in at least one language of the labelled rows; texts far below what labelled texts reach
are in none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, batch_of, python_tasks, texts

#: Labelled texts per language that are expected in the sample.
PER_LABEL = 1000
#: A pair is usual in a language if it makes up this share of its letter pairs (so a language
#: has at most 20,000 usual pairs).
USUAL = 1 / 20_000
#: The floor is this part of the quantile below of the shares of labelled texts.
QUANTILE, PART = 0.001, 0.5


@dataclass
class LetterPairs:
    pairs: np.ndarray  # sorted codes
    floor: float


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def pair_codes(text: str) -> np.ndarray:
    """Codes of all pairs of neighbouring letters of a text, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    both = is_letter[:-1] & is_letter[1:]
    return (points[:-1][both] << 21) | points[1:][both]


def known_share(text: str, pairs: np.ndarray) -> float:
    """Share of a text's letter pairs that are among ``pairs``; 1 for a text without pairs."""
    codes = pair_codes(text)
    if not len(codes):
        return 1.0
    if not len(pairs):
        return 0.0
    at = np.searchsorted(pairs, codes)
    at[at == len(pairs)] = 0
    return float((pairs[at] == codes).mean())


def share_column(text, pairs: np.ndarray):
    @F.pandas_udf("double")
    def share(series):
        import pandas as pd
        return pd.Series([known_share(t or "", pairs) for t in series], dtype=float)

    return share(text)


def learn_letter_pairs(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                       per_label: int = PER_LABEL) -> LetterPairs | None:
    """Usual letter pairs and floor from labelled rows; None if no sampled text has a pair.

    The sample is what falls below ``per_label / rows`` by hashed id in each language; rows
    with a null label, text or id are not in it. The floor comes from texts held against the
    pairs of the sample's other half: against pairs that it gave itself a text always looks
    usual, above all in a small sample. If the other half has no pairs, all pairs serve. Labels meet only ids, whole texts only the
    staged ids. The driver reads the usual pairs alone.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "letter-pairs")
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("text"))
    counts = staging.write(rows.groupBy("l").agg(F.count("*").alias("n")), "counts")
    scale = 1 << 30
    drawn = staging.write(rows.select("i", "l").join(counts, "l")
                          .where(F.pmod(F.xxhash64("i", F.lit(2)), F.lit(scale)) < F.lit(per_label * scale) / F.col("n"))
                          .select("i", "l").distinct()
                          .withColumn("half", F.pmod(F.xxhash64("i", F.lit(3)), F.lit(2)).cast("int")), "drawn")
    sample = staging.write(rows.join(drawn, ["i", "l"]).select("l", "half", "text"), "sample")
    schema = pa.schema([("l", pa.string()), ("half", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_part: dict[tuple, list] = {}
            for lang, half, t in zip(b.column("l").to_pylist(), b.column("half").to_pylist(), texts(b)):
                by_part.setdefault((lang, half), []).append(pair_codes(t))
            for (lang, half), codes in by_part.items():
                pairs, n = np.unique(np.concatenate(codes), return_counts=True)
                yield batch_of(schema, [[lang] * len(pairs), [half] * len(pairs), pairs, n])

    found = staging.write(sample.mapInArrow(count, "l string, half int, pair long, n long")
                          .groupBy("l", "half", "pair").agg(F.sum("n").alias("n")), "pairs")

    def usual(part: DataFrame) -> np.ndarray:
        summed = part.groupBy("l", "pair").agg(F.sum("n").alias("n"))
        totals = part.groupBy("l").agg(F.sum("n").alias("total"))
        often = summed.join(totals, "l").where(F.col("n") >= F.lit(USUAL) * F.col("total")).select("pair").distinct()
        return np.sort(np.array([r[0] for r in often.collect()], np.int64))

    pairs = usual(found)
    if not len(pairs):
        return None
    other = [usual(found.where(F.col("half") == 1 - h)) for h in (0, 1)]
    other = [u if len(u) else pairs for u in other]
    share = F.when(F.col("half") == 0, share_column(F.col("text"), other[0])).otherwise(
        share_column(F.col("text"), other[1]))
    low = sample.select(share.alias("s")).agg(F.percentile_approx("s", QUANTILE, 100_000)).first()[0]
    for t in (counts, drawn, sample, found):
        staging.drop(t)
    return LetterPairs(pairs, PART * low)


def in_learned_language(text, known: LetterPairs | None):
    """Whether a text column's known share reaches the floor. Null and empty texts and those
    without two neighbouring letters do, and all do when nothing was learned."""
    return F.lit(True) if known is None else share_column(text.cast("string"), known.pairs) >= known.floor
