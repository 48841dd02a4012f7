"""Grouped counts, sums and group tests.

All are one ``groupBy().agg()``: Spark aggregates partially inside each map task before
the shuffle, so a key that holds a large share of the rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_count(df: DataFrame, keys: str | Sequence[str], name: str = "count") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(name))


def group_sum(df: DataFrame, keys: str | Sequence[str], expr: str | Column, name: str) -> DataFrame:
    """Sum of an expression per group; NULL values are skipped, a group of NULLs sums to NULL."""
    e = F.col(expr) if isinstance(expr, str) else expr
    return df.groupBy(*_keys(keys)).agg(F.sum(e).alias(name))


def count_distinct_by(df: DataFrame, keys: str | Sequence[str], col: str, name: str) -> DataFrame:
    """Exact number of distinct non-NULL ``col`` values per group."""
    return df.groupBy(*_keys(keys)).agg(F.count_distinct(F.col(col)).alias(name))


def count_distinct_ids(df: DataFrame, keys: str | Sequence[str], col: str, name: str) -> DataFrame:
    """Exact number of distinct non-NULL ``col`` values per group, for a whole-number column.

    Ids are marked in bitmaps of 32,768 neighbouring ids. A map task sends one bitmap (4 KB) per
    group and range of ids it met, in place of one row per (group, id), and a large group is
    spread over its ranges, so no task holds all its ids. Made for few groups with ids that lie
    close together; where a task meets under about 200 ids per group and range (scattered ids,
    many small groups), :func:`count_distinct_by` moves less. Negative ids count like others; a
    group of NULL ids counts 0.
    """
    kind = df.schema[col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{col} is {kind.simpleString()}: bitmaps need a whole-number column")
    bucket, bitmap = "__crashlens_bucket", "__crashlens_bitmap"
    value = F.col(col).cast("long")
    marked = (df.select(*_keys(keys), F.bitmap_bucket_number(value).alias(bucket),
                        F.bitmap_bit_position(value).alias(bitmap))
              .groupBy(*_keys(keys), bucket).agg(F.bitmap_construct_agg(bitmap).alias(bitmap)))
    return marked.groupBy(*_keys(keys)).agg(F.sum(F.bitmap_count(bitmap)).alias(name))


def conditional_count(df: DataFrame, keys: str | Sequence[str], cond: Column, name: str) -> DataFrame:
    """Rows per group for which ``cond`` is true (NULL counts as not true)."""
    return df.groupBy(*_keys(keys)).agg(F.count_if(cond).alias(name))


def groups_with_more_than(df: DataFrame, keys: str | Sequence[str], cond: Column, n: int,
                          name: str = "count") -> DataFrame:
    """Groups with more than ``n`` rows matching ``cond``, with that count.

    The filter runs before the grouping, so groups without a match never reach the shuffle.
    """
    return (df.where(cond).groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(name))
            .where(F.col(name) > n))


def groups_without(df: DataFrame, keys: str | Sequence[str], cond: Column) -> DataFrame:
    """Keys of the groups in which no row satisfies ``cond`` (a NULL result is not a match).

    One aggregation pass; the same keys as an anti join against the matching keys.
    """
    flag = "__crashlens_matches"
    return (df.groupBy(*_keys(keys)).agg(F.count_if(cond).alias(flag))
            .where(F.col(flag) == 0).drop(flag))
