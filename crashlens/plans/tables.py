"""The set of incident tables a question reads, with their keyed dedup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from crashlens.operators.dedup import dedup_by_key, dedup_columns, dedup_where
from crashlens.sources.schemas import (CHARGE_KEY, CHARGES, DAMAGE_KEY, DAMAGES, ENDORSE,
                                       PERSON, PERSON_KEY, RESTRICT, UNIT_KEY, UNITS)


@dataclass(frozen=True)
class Incidents:
    """Units, Primary_Person, Charges, Damages (and the two profiled-only tables).

    ``deduped=True`` states that the four question tables already hold one row per key
    (for instance after :func:`crashlens.plans.job.stage_deduped`), so the questions read
    them as they are.
    """

    units: DataFrame
    primary_person: DataFrame
    charges: DataFrame | None = None
    damages: DataFrame | None = None
    endorse: DataFrame | None = None
    restrict: DataFrame | None = None
    deduped: bool = False
    staged: tuple[str, tuple[str, ...]] | None = None  # folder and catalog tables to release

    @classmethod
    def from_mapping(cls, tables: Mapping[str, DataFrame]) -> "Incidents":
        return cls(units=tables[UNITS], primary_person=tables[PERSON],
                   charges=tables.get(CHARGES), damages=tables.get(DAMAGES),
                   endorse=tables.get(ENDORSE), restrict=tables.get(RESTRICT))

    def _one_per_key(self, df: DataFrame | None, keys: tuple[str, ...], name: str,
                     cols: Sequence[str] | None = None, cond: Column | None = None) -> DataFrame:
        """One row per key. ``cols`` alone: at least those columns and the key. With ``cond``,
        which reads ``cols``: all columns of the kept rows that pass it."""
        if df is None:
            raise ValueError(f"table {name!r} is needed by this question")
        if self.deduped:
            return df if cond is None else df.where(cond)
        if cond is not None:
            return dedup_where(df, keys, cond, cols)
        return dedup_by_key(df, keys) if cols is None else dedup_columns(df, keys, cols)

    def units_by_key(self) -> DataFrame:
        """Units, one row per ``(crash_id, unit_nbr)``."""
        return self._one_per_key(self.units, UNIT_KEY, UNITS)

    def persons_by_key(self) -> DataFrame:
        """Primary_Person, one row per ``(crash_id, unit_nbr)``."""
        return self._one_per_key(self.primary_person, PERSON_KEY, PERSON)

    def units_with(self, cols: Sequence[str], cond: Column | None = None) -> DataFrame:
        """:meth:`units_by_key` for a question that needs only ``cols``, or the rows of ``cond``."""
        return self._one_per_key(self.units, UNIT_KEY, UNITS, cols, cond)

    def persons_with(self, cols: Sequence[str], cond: Column | None = None) -> DataFrame:
        """:meth:`persons_by_key` for a question that needs only ``cols``, or the rows of ``cond``."""
        return self._one_per_key(self.primary_person, PERSON_KEY, PERSON, cols, cond)

    def charges_by_key(self) -> DataFrame:
        """Charges, one row per ``(crash_id, unit_nbr, prsn_nbr)``."""
        return self._one_per_key(self.charges, CHARGE_KEY, CHARGES)

    def damages_by_key(self) -> DataFrame:
        """Damages, one row per ``crash_id``."""
        return self._one_per_key(self.damages, DAMAGE_KEY, DAMAGES)

    def with_tables(self, **changes) -> "Incidents":
        return replace(self, **changes)
