"""Top-k, rank bands and the best row per group.

Ties are broken by the tie columns ascending (by default the group columns), so every
result is the same for any input order or partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.session import staging_path

_RN = "__crashlens_rn"
_RANGE, _N, _BEFORE = "__crashlens_range", "__crashlens_n", "__crashlens_before"


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _ordering(measure: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(measure).desc_nulls_last()] + [F.col(t).asc_nulls_last() for t in ties]


def top_k(df: DataFrame, measure: str, k: int, ties: str | Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``measure``; planned as ``TakeOrderedAndProject``
    (each task keeps its own top ``k``, only those are merged)."""
    return df.orderBy(*_ordering(measure, _names(ties))).limit(k)


def top_k_count(df: DataFrame, group: str | Sequence[str], k: int, name: str = "count") -> DataFrame:
    """The ``k`` groups with most rows."""
    g = _names(group)
    counted = df.groupBy(*g).agg(F.count(F.lit(1)).alias(name))
    return top_k(counted, name, k, g)


def rank_band(df: DataFrame, measure: str, first: int, last: int,
              ties: str | Sequence[str] = ()) -> DataFrame:
    """Rows ranked ``first`` to ``last`` (1-based, inclusive) by ``measure`` descending.

    Limit then offset: each task keeps its own top ``last`` rows, and those are merged in one
    task, which therefore holds ``last`` rows per task at most. Meant for bands near the top;
    :func:`deep_rank_band` is for the others.
    """
    return df.orderBy(*_ordering(measure, _names(ties))).limit(last).offset(first - 1)


def global_ranks(df: DataFrame, measure: str, ties: str | Sequence[str] = (), name: str = "rank",
                 first: int | None = None, last: int | None = None) -> DataFrame:
    """``df`` with each row's rank (1-based) by ``measure`` descending, without a task that sees
    all rows.

    The rows are written once in ranges of the order (to the shared staging folder, so that the
    ranges stand still). A range's first rank is one more than the number of rows in the ranges
    before it, a prefix sum over one row per range; within a range rows are counted by a window.
    With ``first`` and ``last`` only ranges that meet the band are ranked. Rows equal in
    ``measure`` and ``ties`` share a range and follow one another in any order.
    """
    order = _ordering(measure, _names(ties))
    folder = staging_path(df.sparkSession, uuid.uuid4().hex)
    cut = df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id())
    cut.write.parquet(folder)
    rows = df.sparkSession.read.schema(cut.schema).parquet(folder)
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias(_N))
              .withColumn(_BEFORE, F.coalesce(F.sum(_N).over(before), F.lit(0).cast("long"))))
    if first is not None and last is not None:
        ranges = ranges.where((F.col(_BEFORE) < last) & (F.col(_BEFORE) + F.col(_N) >= first))
    within = Window.partitionBy(_RANGE).orderBy(*order)
    ranked = (rows.join(F.broadcast(ranges.select(_RANGE, _BEFORE)), _RANGE)  # a row per range: bounded by the partition count
              .withColumn(name, F.col(_BEFORE) + F.row_number().over(within)))
    if first is not None and last is not None:
        ranked = ranked.where(F.col(name).between(first, last))
    return ranked.drop(_RANGE, _BEFORE)


def deep_rank_band(df: DataFrame, measure: str, first: int, last: int, ties: str | Sequence[str] = ()) -> DataFrame:
    """Rows ranked ``first`` to ``last`` as :func:`rank_band`, for bands of any depth and width.

    All rows are shuffled and written once (:func:`global_ranks`); only the ranges that meet the
    band are read again and sorted. The result is sorted. The written ranges stay in the staging
    folder, which the result reads.
    """
    ranked = global_ranks(df, measure, ties, _RN, first, last)
    return ranked.orderBy(_RN).drop(_RN)


def top_per_group(df: DataFrame, group: str | Sequence[str], measure: str,
                  ties: str | Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``measure`` in each group.

    ``row_number() = 1`` over the group; Spark plans a partial ``WindowGroupLimit`` before
    the shuffle, so a large group sends one row per map task.
    """
    w = Window.partitionBy(*_names(group)).orderBy(*_ordering(measure, _names(ties)))
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
