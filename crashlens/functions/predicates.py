"""Column predicates used by the questions.

All of them are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen and can be pushed towards the scan by Catalyst where the plan allows it.
Three-valued logic is kept on purpose: a NULL input gives NULL, and ``where`` drops the row.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no grade.
NON_GRADES = ("NA", "NO DAMAGE", "INVALID VALUE")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conds: Iterable[Column]) -> Column:
    """OR of the given conditions."""
    return reduce(operator.or_, list(conds))


def ieq(c: str | Column, value: str) -> Column:
    """Case-insensitive equality: ``upper(c) = upper(value)``."""
    return F.upper(_col(c)) == value.upper()


def icontains(c: str | Column, word: str) -> Column:
    """Case-insensitive substring test."""
    return F.upper(_col(c)).contains(word.upper())


def icontains_any(cols: str | Column | Iterable[str | Column], words: str | Iterable[str]) -> Column:
    """True when any of the columns contains any of the words (case-insensitive)."""
    if isinstance(cols, (str, Column)):
        cols = [cols]
    if isinstance(words, str):
        words = [words]
    return any_of(icontains(c, w) for c in cols for w in words)


def not_placeholder(c: str | Column, placeholders: Iterable[str],
                    case_insensitive: bool = True) -> Column:
    """``NOT upper(c) IN (placeholders)``; NULL stays NULL, so ``where`` drops it too.

    With no placeholders only NULL is excluded (Spark reads ``NULL IN ()`` as false, which
    would otherwise let NULL through for an empty list only).
    """
    values = [p.upper() for p in placeholders] if case_insensitive else list(placeholders)
    if not values:
        return _col(c).isNotNull()
    base = F.upper(_col(c)) if case_insensitive else _col(c)
    return ~base.isin(*values)


def null_or_placeholder(c: str | Column, placeholders: Iterable[str] = ("NA",)) -> Column:
    """``c IS NULL OR c IN (placeholders)``, safe on numeric columns.

    The value is compared as text, so a numeric column does not raise a cast error under
    ANSI mode; it simply never equals a word.
    """
    col = _col(c)
    return col.isNull() | col.cast("string").isin(*list(placeholders))


_BLANK = r"[\s\p{Cntrl}\p{Z}]*"
_WHOLE = rf"^{_BLANK}[+-]?[0-9]+{_BLANK}$"
# Blanks around an optional sign and digits with an optional fraction; group 1 is the whole part.
_NUMBER = rf"^{_BLANK}([+-]?[0-9]*)(?:(?<=[0-9])\.?|\.(?=[0-9]))[0-9]*{_BLANK}$"


def int_or_null(c: str | Column, to: str = "int") -> Column:
    """The whole number that a text holds, or NULL; a cheap pattern keeps words from the slow
    failing cast."""
    col = _col(c)
    return F.when(col.rlike(_WHOLE), col.try_cast(to))


def non_numeric(c: str | Column) -> Column:
    """True for codes that are not a number (NULL counts as non-numeric).

    A number is an optional sign and digits with an optional fraction (``1``, ``-1.5``,
    ``.5``, ``1.``), blanks around it allowed, whose whole part is in the range of a 32-bit
    integer. Exponents (``1e3``) and longer numbers are not.
    """
    col = _col(c)
    whole = F.regexp_extract(col, _NUMBER, 1)
    value = F.when(whole.rlike("[0-9]"), whole.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    fits = F.coalesce(value.between(-(2 ** 31), 2 ** 31 - 1), F.lit(False))
    return F.coalesce(~(col.rlike(_NUMBER) & fits), F.lit(True))


def grade_above(cols: str | Column | Iterable[str | Column], threshold: str,
                exclude: Iterable[str] = NON_GRADES) -> Column:
    """Any column whose upper-cased text sorts after ``threshold``, words in ``exclude`` aside.

    Text order, so ``DAMAGED 7 HIGHEST`` is above ``DAMAGED 4``; this holds for one-digit
    grades only.
    """
    if isinstance(cols, (str, Column)):
        cols = [cols]
    words = [w.upper() for w in exclude]
    return any_of((F.upper(_col(c)) > threshold.upper()) & ~F.upper(_col(c)).isin(*words)
                  for c in cols)
