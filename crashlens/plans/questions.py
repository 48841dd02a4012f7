"""The ten questions, each a pure function from the incident tables to a DataFrame.

Every question keeps the surveyed job's order of steps (dedup by key first, filter after)
but makes each choice deterministic: the dedup keeps the first row by a stated order and
ties in top-k go to the group value ascending. No question runs an action or collects to
the driver; each is one Spark plan. Questions whose stored result is a set of rows (2, 4,
9) also have a ``*_count`` form that computes only the number the job printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.predicates import (grade_above, icontains, icontains_any, ieq,
                                            non_numeric, not_placeholder)
from crashlens.operators.dedup import count_entities, dedup_by_key, distinct_entities
from crashlens.operators.groups import (count_distinct_by, group_count, group_sum,
                                        groups_with_more_than)
from crashlens.operators.joins import join_on, semi_join_rows
from crashlens.operators.ranking import rank_band, top_k, top_k_count, top_per_group
from crashlens.plans.tables import Incidents
from crashlens.sources.schemas import (CHARGE_KEY, COUNTER_COLS, CRASH_KEY, UNIT_KEY,
                                       VEHICLE_COLS)

# Fixed values, in question order: the code words each question tests for, the columns it
# tests, and the names of its result columns.
MALE, KILLED = "MALE", "KILLED"                                  # Q1
Q1_COUNT = "count_of_males_killed"
MOTORCYCLE = "MOTORCYCLE"                                        # Q2
CAR, DRIVER, NOT_DEPLOYED = "CAR", "DRIVER", "NOT DEPLOYED"      # Q3
Q3_COUNT = "count"
HIT_AND_RUN = "Y"                                                # Q4
LICENCE_WORDS = ("CLASS", "OTHER")
FEMALE = "FEMALE"                                                # Q5
Q5_COUNT = "count_of_accidents"
Q6_SUM = "death_plus_injry_cnt_per_veh_make_id"                  # Q6
BODY_PLACEHOLDERS = ("NA", "UNKNOWN", "NOT REPORTED")            # Q7
ETHNICITY_PLACEHOLDERS = ("NA", "UNKNOWN")
Q7_COUNT = "count"
ZIP_PLACEHOLDERS = ("UNKNOWN",)                                  # Q8
FACTOR_COLS = ("contrib_factr_1_id", "contrib_factr_2_id", "contrib_factr_p1_id")
ALCOHOL_WORDS = ("ALCOHOL", "DRINKING")
POSITIVE = "POSITIVE"
Q8_COUNT = "crash_count"
NO_DAMAGE_WORDS = ("NONE", "NO DAMAGE")                          # Q9
GRADE_COLS = ("veh_dmag_scl_1_id", "veh_dmag_scl_2_id")
GRADE_THRESHOLD = "DAMAGED 4"
INSURANCE = "INSURANCE"
CODE_PLACEHOLDERS = ("NA",)                                      # Q10, exact match
SPEED = "SPEED"
Q10_COUNT = "offence_count"

# Entity dedup keeps the vehicle row of the smallest (crash_id, unit_nbr).
ENTITY_ORDER = list(UNIT_KEY)


def _raw(t: Incidents, name: str) -> DataFrame:
    """The table with all its rows (the ``"any"`` match modes test rows before the dedup)."""
    if t.deduped:
        raise ValueError(f"match mode 'any' needs the raw {name!r} table, not a deduped one")
    df = getattr(t, name)
    if df is None:
        raise ValueError(f"table {name!r} is needed by this question")
    return df


def q1(t: Incidents, more_than: int = 2) -> DataFrame:
    """Crashes in which more than ``more_than`` males were killed.

    One person row per vehicle (the dedup by ``(crash_id, unit_nbr)``), as in the job.
    Columns: ``crash_id, count_of_males_killed``.
    """
    cond = ieq("prsn_gndr_id", MALE) & ieq("prsn_injry_sev_id", KILLED)
    persons = t.persons_with(("prsn_gndr_id", "prsn_injry_sev_id"))
    return groups_with_more_than(persons, "crash_id", cond, more_than, Q1_COUNT)


def _one_per_vehicle(rows: DataFrame, staged: bool, null_keys: bool = True) -> DataFrame:
    """One row per vehicle. Over staged tables the row is chosen on identity and key columns
    alone, and the whole rows are then fetched from their buckets by their key, which is unique
    after the keyed dedup. Otherwise a second use of ``rows`` would be a second dedup of all the
    raw rows, so the whole rows, which the question's filter has left, are chosen from at once."""
    if not staged:
        return distinct_entities(rows, VEHICLE_COLS, ENTITY_ORDER)
    narrow = rows.select(*UNIT_KEY, *VEHICLE_COLS)
    return semi_join_rows(rows, distinct_entities(narrow, VEHICLE_COLS, ENTITY_ORDER), UNIT_KEY, null_keys)


def _two_wheelers(t: Incidents) -> DataFrame:
    return t.units_with(("veh_body_styl_id",), icontains("veh_body_styl_id", MOTORCYCLE))


def q2(t: Incidents) -> DataFrame:
    """Two-wheelers booked for crashes: one Units row per distinct vehicle whose body
    style mentions MOTORCYCLE (the row of the smallest ``(crash_id, unit_nbr)``)."""
    return _one_per_vehicle(_two_wheelers(t), t.deduped)


def q2_count(t: Incidents) -> DataFrame:
    """Number of rows of :func:`q2`, as column ``n``."""
    units = t.units_with((*VEHICLE_COLS, "veh_body_styl_id"))
    return count_entities(units.where(icontains("veh_body_styl_id", MOTORCYCLE)), VEHICLE_COLS)


def q3(t: Incidents, k: int = 5) -> DataFrame:
    """Top ``k`` makes of cars whose driver died with the airbag not deployed, counted as
    distinct vehicles. Columns: ``veh_make_id, count``.

    The make is part of the vehicle identity, so distinct vehicles per make need only the
    four identity columns (no full-row pick).
    """
    units = t.units_with((*VEHICLE_COLS, "veh_body_styl_id")).where(icontains("veh_body_styl_id", CAR))
    persons = (t.persons_with(("prsn_type_id", "prsn_airbag_id", "prsn_injry_sev_id"))
               .where(ieq("prsn_type_id", DRIVER) & ieq("prsn_airbag_id", NOT_DEPLOYED)
                      & ieq("prsn_injry_sev_id", KILLED)))
    joined = join_on(units.select(*UNIT_KEY, *VEHICLE_COLS), persons.select(*UNIT_KEY), UNIT_KEY)
    return top_k_count(joined.select(*VEHICLE_COLS).distinct(), "veh_make_id", k, Q3_COUNT)


def _hit_and_run(t: Incidents) -> DataFrame:
    units = t.units_with(("veh_hnr_fl",), ieq("veh_hnr_fl", HIT_AND_RUN)).drop(*COUNTER_COLS)
    persons = t.persons_with(("prsn_type_id", "drvr_lic_cls_id"),
                               icontains("prsn_type_id", DRIVER) & icontains_any("drvr_lic_cls_id", LICENCE_WORDS))
    return join_on(units, persons, UNIT_KEY, collisions="drop_left")


def q4(t: Incidents) -> DataFrame:
    """Vehicles with a licensed driver involved in hit and run: the joined Units/Person
    rows, one per distinct vehicle. The Units copies of the injury counters are dropped so
    the written result has unique column names."""
    return _one_per_vehicle(_hit_and_run(t), t.deduped, null_keys=False)


def q4_count(t: Incidents) -> DataFrame:
    """Number of rows of :func:`q4`, as column ``n``."""
    units = t.units_with((*VEHICLE_COLS, "veh_hnr_fl")).where(ieq("veh_hnr_fl", HIT_AND_RUN))
    persons = (t.persons_with(("prsn_type_id", "drvr_lic_cls_id"))
               .where(icontains("prsn_type_id", DRIVER) & icontains_any("drvr_lic_cls_id", LICENCE_WORDS)))
    joined = join_on(units.select(*UNIT_KEY, *VEHICLE_COLS), persons.select(*UNIT_KEY), UNIT_KEY)
    return count_entities(joined, VEHICLE_COLS)


def q5(t: Incidents, k: int = 1, placeholders: tuple[str, ...] = ()) -> DataFrame:
    """The driver-licence state with most crashes in which no person is female.

    Columns: ``drvr_lic_state_id, count_of_accidents``. Persons are first reduced to one
    row per ``(crash, state)`` with their female count (partial aggregation, so a crash
    with very many rows shrinks to at most one row per state before any shuffle); the
    crash-level test is then a window over those few rows per crash (a crash has at most
    one row per distinct state). The dedup reads the columns up to the licence state only: those
    behind it cannot change a kept row's gender or state. Same answer as "crashes without females, joined back to
    persons, distinct crashes per state". State codes such as ``NA`` are counted like any
    other state, as in the job, unless listed in ``placeholders`` (then NULL is left out
    too); the female test still sees every person.
    """
    female = "__crashlens_females"
    per_state = (t.persons_with(("prsn_gndr_id", "drvr_lic_state_id")).where(F.col("crash_id").isNotNull())
                 .groupBy("crash_id", "drvr_lic_state_id")
                 .agg(F.count_if(ieq("prsn_gndr_id", FEMALE)).alias(female)))
    no_female = (per_state
                 .withColumn(female, F.sum(female).over(Window.partitionBy("crash_id")))
                 .where(F.col(female) == 0))
    if placeholders:
        no_female = no_female.where(not_placeholder("drvr_lic_state_id", placeholders))
    counted = group_count(no_female, "drvr_lic_state_id", Q5_COUNT)
    return top_k(counted, Q5_COUNT, k, "drvr_lic_state_id")


def q6(t: Incidents, first: int = 3, last: int = 5) -> DataFrame:
    """Makes ranked ``first`` to ``last`` by injuries plus deaths.

    Columns: ``veh_make_id, death_plus_injry_cnt_per_veh_make_id``. A row with a NULL
    counter adds nothing (NULL + n is NULL, and ``sum`` skips it).
    """
    summed = group_sum(t.units_by_key(), "veh_make_id",
                       F.col("tot_injry_cnt") + F.col("death_cnt"), Q6_SUM)
    return rank_band(summed, Q6_SUM, first, last, "veh_make_id")


def q7(t: Incidents) -> DataFrame:
    """Top ethnic group per body style, sorted by its count.

    Columns: ``veh_body_styl_id, prsn_ethnicity_id, count``.
    """
    units = t.units_with(("veh_body_styl_id",)).where(not_placeholder("veh_body_styl_id", BODY_PLACEHOLDERS))
    persons = t.persons_with(("prsn_ethnicity_id",)).where(not_placeholder("prsn_ethnicity_id", ETHNICITY_PLACEHOLDERS))
    joined = join_on(units.select(*UNIT_KEY, "veh_body_styl_id"),
                     persons.select(*UNIT_KEY, "prsn_ethnicity_id"), UNIT_KEY)
    counted = group_count(joined, ["veh_body_styl_id", "prsn_ethnicity_id"], Q7_COUNT)
    best = top_per_group(counted, "veh_body_styl_id", Q7_COUNT, "prsn_ethnicity_id")
    return best.orderBy(F.col(Q7_COUNT).desc(), F.col("veh_body_styl_id").asc_nulls_last())


def q8(t: Incidents, k: int = 5, body_style: str | None = None) -> DataFrame:
    """Top ``k`` driver zips by crashes with alcohol as a factor (any factor column
    mentions ALCOHOL or DRINKING, or the test result is POSITIVE).

    Columns: ``drvr_zip, crash_count``. All units are taken, as in the job, unless
    ``body_style`` names a word the body style must contain (``"CAR"`` for cars only).
    """
    persons = t.persons_by_key().where(F.col("drvr_zip").isNotNull()
                                       & not_placeholder("drvr_zip", ZIP_PLACEHOLDERS))
    units = t.units_by_key()
    if body_style:
        units = units.where(icontains("veh_body_styl_id", body_style))
    joined = join_on(units.select(*UNIT_KEY, *FACTOR_COLS),
                     persons.select(*UNIT_KEY, "drvr_zip", "prsn_alc_rslt_id"), UNIT_KEY)
    alcohol = joined.where(icontains_any(FACTOR_COLS, ALCOHOL_WORDS)
                           | icontains("prsn_alc_rslt_id", POSITIVE))
    counted = count_distinct_by(alcohol, "drvr_zip", "crash_id", Q8_COUNT)
    return top_k(counted, Q8_COUNT, k, "drvr_zip")


def _q9_sides(t: Incidents, damage_match: str) -> tuple[DataFrame, DataFrame]:
    units = t.units_by_key().where(grade_above(GRADE_COLS, GRADE_THRESHOLD)
                                   & icontains("fin_resp_type_id", INSURANCE))
    no_damage = icontains_any("damaged_property", NO_DAMAGE_WORDS)
    if damage_match == "first":
        damages = t.damages_by_key().where(no_damage)
    elif damage_match == "any":
        damages = dedup_by_key(_raw(t, "damages").where(no_damage), CRASH_KEY)
    else:
        raise ValueError(f"damage_match must be 'first' or 'any', not {damage_match!r}")
    return units, damages


def q9(t: Incidents, damage_match: str = "first") -> DataFrame:
    """Distinct crashes with no damaged property, a damage grade above 4 and insurance:
    one Units row per crash (smallest ``unit_nbr``) with its ``damaged_property``, sorted
    by ``crash_id`` descending.

    ``damage_match="first"`` (the job's rule) tests the one damage row kept per crash;
    ``"any"`` accepts a crash if any of its damage rows says no damage.

    Damages hold one row per crash, so picking the unit per crash before the join gives the
    same rows as after it; the join is then one-to-one on ``crash_id`` and a crash with
    very many units is reduced inside the map tasks first.
    """
    units, damages = _q9_sides(t, damage_match)
    one_per_crash = dedup_by_key(units, CRASH_KEY, ["unit_nbr"])  # unique within a crash
    return join_on(one_per_crash, damages, CRASH_KEY).orderBy(F.col("crash_id").desc())


def q9_count(t: Incidents, damage_match: str = "first") -> DataFrame:
    """Number of rows of :func:`q9`, as column ``n``."""
    units, damages = _q9_sides(t, damage_match)
    crashes = units.select("crash_id").distinct()
    return crashes.join(damages.select("crash_id"), "crash_id", "left_semi") \
        .agg(F.count(F.lit(1)).alias("n"))


def _best_codes(units: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row and column: the most common codes of each code column as ``column=code`` texts,
    numbers and placeholders left out (ties by code)."""
    codes = (units.select(*limits).unpivot([], list(limits), "column", "code")
             .where(not_placeholder("code", CODE_PLACEHOLDERS, case_insensitive=False)))
    counted = group_count(codes, ["column", "code"], "n").where(non_numeric("code"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("code").asc())
    wanted = F.lit(False)
    for column, k in limits.items():
        wanted |= (F.col("column") == column) & (F.col("rank") <= k)
    top = (counted.withColumn("rank", F.row_number().over(order))
           .where(F.col("rank") <= max(limits.values())).where(wanted))
    return top.agg(F.collect_list(F.concat_ws("=", "column", "code")).alias("best"))


def q10(t: Incidents, k: int = 5, top_colours: int = 10, top_states: int = 25,
        charge_match: str = "first") -> DataFrame:
    """Top ``k`` makes by speeding charges of licensed drivers, for vehicles with one of the
    ``top_colours`` most common colours and licensed in one of the ``top_states`` states
    with most vehicles. Columns: ``veh_make_id, offence_count``.

    Colour and state codes that are numbers, and the exact code ``NA``, are left out of the
    two rankings. Both rankings come from one pass: the two code columns are stacked and
    counted in one aggregate, and the best codes of each become one short list (at most
    ``top_colours + top_states`` values) in a one-row scalar subquery of the same plan.
    Units and persons are joined first (both are already partitioned on the unit key by
    their dedup), then charges on the three person keys. ``charge_match="first"`` (the
    job's rule) tests the one charge kept per person; ``"any"`` counts a person with any
    speeding charge.
    """
    units = t.units_by_key()
    ranked = units
    if not t.deduped:
        # The joins below need a key, and Catalyst pushes that not-NULL test under the dedup,
        # which would make the joined branch a second dedup of Units. Splitting Units into
        # rows with and without a key (together exactly Units) lets the ranking and the join
        # share one dedup shuffle; only the rows without a key are deduped apart.
        has_key = F.col("crash_id").isNotNull() & F.col("unit_nbr").isNotNull()
        units, without = units.where(has_key), units.where(~has_key)
        ranked = units.unionByName(without)
    limits = {"veh_color_id": top_colours, "veh_lic_state_id": top_states}
    own = F.array(*[F.concat(F.lit(f"{name}="), F.col(name)) for name in limits])
    best = _best_codes(ranked, limits).scalar()
    # One reference to the subquery, so that it is planned once.
    units = units.where(F.size(F.array_intersect(best, own)) == len(limits))
    persons = t.persons_by_key().where(icontains("prsn_type_id", DRIVER)
                                       & icontains_any("drvr_lic_cls_id", LICENCE_WORDS))
    speeding = icontains("charge", SPEED)
    if charge_match == "first":
        charges = t.charges_by_key().where(speeding)
    elif charge_match == "any":
        charges = dedup_by_key(_raw(t, "charges").where(speeding), CHARGE_KEY)
    else:
        raise ValueError(f"charge_match must be 'first' or 'any', not {charge_match!r}")
    joined = join_on(units.select(*UNIT_KEY, "veh_make_id"),
                     persons.select(*CHARGE_KEY), UNIT_KEY)
    joined = join_on(joined, charges.select(*CHARGE_KEY), CHARGE_KEY)
    return top_k_count(joined, "veh_make_id", k, Q10_COUNT)


QUESTIONS = {
    "q1": q1, "q2": q2, "q3": q3, "q4": q4, "q5": q5,
    "q6": q6, "q7": q7, "q8": q8, "q9": q9, "q10": q10,
}
