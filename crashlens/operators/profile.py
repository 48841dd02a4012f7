"""Table profiler: the manual data checks of the exploratory notebook as a few aggregates.

Each function returns a DataFrame and runs no action; the caller shows or writes it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions.predicates import null_or_placeholder
from crashlens.operators.dedup import distinct_entities

#: Values that a frequent-items sketch of Spark tracks at most.
MAX_TRACKED = 1_000_000


def schema_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``(column, type, nullable)`` per column, from the plan's schema (no data read)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    schema = T.StructType([T.StructField("column", T.StringType(), False),
                           T.StructField("type", T.StringType(), False),
                           T.StructField("nullable", T.BooleanType(), False)])
    return spark.createDataFrame(rows, schema)


def profile_table(df: DataFrame, keys: Sequence[str], missing_col: str | None = None,
                  placeholders: Iterable[str] = ("NA",)) -> DataFrame:
    """One row: ``n_rows``, ``n_distinct_rows``, ``n_keys`` and ``n_missing``.

    ``n_keys`` counts distinct key tuples with NULL as a value (as ``select(keys).distinct()``
    does); ``n_missing`` counts rows whose ``missing_col`` (default: first key) is NULL or a
    placeholder. Whole rows are grouped first, with partial aggregation inside each task,
    so exact copies collapse before the shuffle; the four numbers then come out of one
    aggregate over the distinct rows, no second scan and no join.
    """
    missing_col = missing_col or keys[0]
    c = "__crashlens_copies"
    m = "__crashlens_missing"
    rows = (df.withColumn(m, null_or_placeholder(missing_col, placeholders))
            .groupBy(*df.columns, m).agg(F.count(F.lit(1)).alias(c)))
    return rows.agg(
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_rows"),
        F.count_distinct(F.struct(*[F.col(k) for k in keys])).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col(m), F.col(c))), F.lit(0)).cast("long").alias("n_missing"),
    )


def key_counts(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """One row: ``n_rows`` and ``n_keys_<col>_<col>...`` per candidate key, the number of
    distinct tuples of those columns (NULL counted as a value), to see which column set
    identifies a row.

    Each candidate is a ``distinct`` of its own columns, taken from the ``distinct`` of a wider
    candidate where there is one; the counts meet as single rows. (Several distinct counts in
    one aggregate would send each row once per candidate.)
    """
    distinct: dict[tuple[str, ...], DataFrame] = {}
    for cols in sorted({tuple(c) for c in candidates}, key=lambda c: (-len(c), c)):
        wider = [w for w in distinct if set(cols) < set(w)]
        source = distinct[min(wider, key=len)] if wider else df
        distinct[cols] = source.select(*[F.col(f"`{c}`") for c in cols]).distinct()
    names = ["n_rows"] + ["n_keys_" + "_".join(c) for c in candidates]
    counted = [df, *[distinct[tuple(c)] for c in candidates]]
    rows = None
    for name, d in zip(names, counted):
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.union(one)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names])


def missing_counts(df: DataFrame, cols: Sequence[str], placeholders: Iterable[str] = ("NA",)) -> DataFrame:
    """One row with ``n_missing_<col>``: rows that are NULL or a placeholder, per column."""
    ph = list(placeholders)
    return df.agg(*[F.count_if(null_or_placeholder(c, ph)).alias(f"n_missing_{c}") for c in cols])


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form ``(column, value, n)``: every value of every listed column with its count.

    The columns are cast to text and unpivoted, so all of them are counted in one
    aggregation (one shuffle of partial counts) instead of one job per column.
    """
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = cast.unpivot([], list(cols), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def heavy_values(df: DataFrame, col: str, min_share: float = 0.001) -> DataFrame:
    """``(value, n)`` for each value of ``col`` that at least ``min_share`` of all rows have, with
    its exact number of rows. NULL is not a value here (``missing_counts`` counts it).

    For columns that are nearly unique, where ``value_counts`` shuffles a row per value. A first
    reading proposes values by a frequent-items sketch, which tasks merge; a second one counts
    the proposed values alone. A tracked value's estimate is never below its count and at most
    3.5 / slots of the rows above it. The slots are chosen so that this is a quarter of
    ``min_share``: of the values whose estimate reaches the share there are at most
    4 / (3 * min_share), and that many are proposed, so none is missed and the list is
    bounded by the share and not by the data.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share lies above 0 and is 1 at most")
    proposed = math.ceil(4 / (3 * min_share))
    tracked = max(math.ceil(0.75 * 14 / min_share), proposed)
    if tracked > MAX_TRACKED:
        raise ValueError(f"min_share is {0.75 * 14 / MAX_TRACKED} at least")
    value = F.col(f"`{col}`")
    found = df.agg(F.count(F.lit(1)).alias("n_rows"), F.expr(
        f"approx_top_k(`{col}`, {proposed}, {tracked})").alias("top"))
    heavy = found.select("n_rows", F.explode("top.item").alias("value")).where("value is not null")
    # The bound on the proposed values makes the broadcast safe; the table is not shuffled.
    counted = df.select(value.alias("v")).join(F.broadcast(heavy), F.col("v") == F.col("value"))
    return (counted.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first("n_rows").alias("n_rows"))
            .where(F.col("n") >= F.lit(min_share) * F.col("n_rows")).select("value", "n"))


def largest_keys(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` largest distinct values of ``key``, to spot outliers."""
    return df.select(key).distinct().orderBy(F.col(key).desc_nulls_last()).limit(n)


def sample_entities(df: DataFrame, cols: Sequence[str], n: int = 20) -> DataFrame:
    """``n`` deduplicated entities, for a look at what the identity columns collapse: those that
    come first by the identity columns (ascending, NULLs last), each with its first row.

    Only identity columns are ranked; the whole rows of the ``n`` entities alone are deduplicated.
    """
    quoted = [F.col(f"`{c}`") for c in cols]
    chosen = df.select(*quoted).distinct().orderBy(*[c.asc_nulls_last() for c in quoted]).limit(n)
    marked = chosen.select(*[c.alias(f"__crashlens_{i}") for i, c in enumerate(quoted)])
    same = F.lit(True)
    for i, c in enumerate(quoted):
        same &= c.eqNullSafe(F.col(f"__crashlens_{i}"))
    return distinct_entities(df.join(marked, same, "left_semi"), cols)
