"""Deterministic keyed dedup (keep one row per key, chosen by a stated order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.operators.joins import _quoted

_RN = "__crashlens_rn"


def _order_cols(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None) -> list[Column]:
    if order is None:
        key_set = {k.lower() for k in keys}
        order = [c for c in df.columns if c.lower() not in key_set]
    out = []
    for o in order:
        out.append(_quoted(o).asc_nulls_last() if isinstance(o, str) else o)
    return out


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (default: every other column in
    table order, ascending, NULLs last). Rows left tied are equal in all order columns.

    NULL keys form one group, as with ``dropDuplicates``. Planned as
    ``row_number() = 1``: Spark inserts a partial ``WindowGroupLimit`` before the shuffle,
    so each map task sends at most one row per key and a key holding a large share of the
    rows does not land whole in one task. The output stays hash-partitioned on ``keys``,
    which a following join on the same keys reuses without another shuffle.
    """
    keys = list(keys)
    order_cols = _order_cols(df, keys, order)
    if not order_cols:
        # Every column is a key: rows with equal keys are equal, so distinct is enough.
        return df.distinct()
    w = Window.partitionBy(*map(_quoted, keys)).orderBy(*order_cols)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def dedup_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``dedup_by_key(df, keys)`` with the columns ``keys`` and ``cols`` only.

    Rows that are equal up to the last of ``cols`` in table order agree in all of ``cols``, so
    the later columns decide nothing that is returned: they are neither sorted nor shuffled.
    """
    wanted = {c.lower() for c in cols} - {k.lower() for k in keys}
    order = [c for c in df.columns if c.lower() not in {k.lower() for k in keys}]
    last = max((i for i, c in enumerate(order) if c.lower() in wanted), default=-1)
    read = {c.lower() for c in (*keys, *order[:last + 1])}
    one = dedup_by_key(df.select(*[_quoted(c) for c in df.columns if c.lower() in read]), keys)
    kept = wanted | {k.lower() for k in keys}
    return one.select(*[_quoted(c) for c in one.columns if c.lower() in kept])


def dedup_where(df: DataFrame, keys: Sequence[str], cond: Column, reads: Sequence[str]) -> DataFrame:
    """``dedup_by_key(df, keys).where(cond)``, where ``cond`` reads only ``keys`` and ``reads``.

    The columns behind the last of ``reads`` in table order only choose among rows for which
    ``cond`` is the same, so rows that fail it travel without them (as NULL).
    """
    wanted = {c.lower() for c in reads}
    order = [c for c in df.columns if c.lower() not in {k.lower() for k in keys}]
    last = max((i for i, c in enumerate(order) if c.lower() in wanted), default=-1)
    later = {c.lower() for c in order[last + 1:]}
    slim = df.select(*[F.when(cond, _quoted(c)).alias(c) if c.lower() in later else _quoted(c) for c in df.columns])
    return dedup_by_key(slim, keys).where(cond)


def distinct_entities(df: DataFrame, cols: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per entity identified by ``cols`` (NULL equals NULL, ``NA`` is a value).

    The same operator as :func:`dedup_by_key`, named for its use on derived identities.
    """
    return dedup_by_key(df, cols, order)


def count_entities(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Number of distinct entities in one row; which row represents an entity does not
    matter for a count, so only the identity columns are read and aggregated
    (partial aggregation before the shuffle)."""
    return df.select(*map(_quoted, cols)).distinct().agg(F.count(F.lit(1)).alias(name))
