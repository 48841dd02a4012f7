"""Joins: collision-safe equi join and restriction to a bounded allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _pairs(on: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]],
            how: str = "inner", collisions: str = "error") -> DataFrame:
    """Equi join that never yields two columns of the same name.

    ``on`` is a list of shared names or ``(left_name, right_name)`` pairs; the left key
    names are kept, once, as with a ``USING`` join. Non-key names present on both sides
    (compared case-insensitively, as Spark resolves them) are handled by ``collisions``:
    ``"error"`` raises, ``"drop_left"`` / ``"drop_right"`` drop that side's copy,
    ``"prefix"`` renames the right copy to ``r_<name>``.
    """
    if collisions not in ("error", "drop_left", "drop_right", "prefix"):
        raise ValueError(f"unknown collisions mode {collisions!r}")
    pairs = _pairs(on)
    key_of = {r.lower(): l for l, r in pairs}  # right key -> the left name that is kept
    left_keys = {l.lower() for l, _ in pairs}
    lnames = {c.lower(): c for c in left.columns if c.lower() not in left_keys}
    rnames = {c.lower(): c for c in right.columns if c.lower() not in key_of}
    # A right column named like a left key would sit next to the kept key: the right copy goes
    # (or is renamed), never the key.
    key_clash = sorted(left_keys & set(rnames))
    clash = sorted(set(lnames) & set(rnames))
    if collisions == "error" and (key_clash or clash):
        raise ValueError(f"columns on both sides of the join: {key_clash + clash}")
    if collisions == "drop_left":
        left = left.select(*[_quoted(c) for c in left.columns if c.lower() not in clash])
    out = {r: r for r in rnames.values()}
    taken = {c.lower() for c in left.columns} | left_keys | set(rnames)
    for c in key_clash + clash:
        if collisions == "prefix":
            new = f"r_{rnames[c]}"
            while new.lower() in taken:
                new = f"r_{new}"
            taken.add(new.lower())
            out[rnames[c]] = new
        elif c in key_clash or collisions == "drop_right":
            del out[rnames[c]]
    # One projection renames all right columns at once, so keys that swap names do not meet.
    right = right.select(*[_quoted(c).alias(key_of[c.lower()] if c.lower() in key_of else out[c])
                           for c in right.columns if c.lower() in key_of or c in out])
    return left.join(right, [l for l, _ in pairs], how)


def restrict_to(df: DataFrame, allowed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``allowed`` (a ``left_semi`` join, no driver collect).

    There is no broadcast hint: a top-k carries its row bound in the plan's statistics, and
    the planner broadcasts it for that; any other ``allowed`` is joined as its size demands.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(allowed.select(*[_quoted(k) for k in keys]), keys, "left_semi")


def semi_join_rows(wide: DataFrame, chosen: DataFrame, keys: Sequence[str],
                   null_keys: bool = True) -> DataFrame:
    """Rows of ``wide`` whose key is in ``chosen``, NULL equal to NULL.

    Rows with a whole key are matched by plain equality, which keeps the partitioning or the
    buckets of ``wide``; only rows with a NULL in the key take the NULL-safe comparison.
    ``null_keys=False`` states that no key holds a NULL (the rows of a join on it).
    """
    if not null_keys:
        return restrict_to(wide, chosen, keys).select(*map(_quoted, wide.columns))
    whole = F.lit(True)
    for k in keys:
        whole &= _quoted(k).isNotNull()
    plain = wide.where(whole).join(chosen.where(whole).select(*map(_quoted, keys)), list(keys), "left_semi")
    rest = chosen.where(~whole).select(*[_quoted(k).alias(f"__crashlens_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= _quoted(k).eqNullSafe(F.col(f"__crashlens_{i}"))
    # A USING join puts the keys first; take the columns in their own order again.
    return plain.select(*map(_quoted, wide.columns)).unionByName(wide.where(~whole).join(rest, same, "left_semi"))
