"""Table names, keys and the column types the questions rely on.

The incident files carry more columns than the questions read, and their exact column
lists are not fixed, so the loader reads every column as text (no inference pass, and
mixed code columns such as model year or zip stay text) and then casts only the columns
named here. Names are matched case-insensitively, as Spark resolves them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Table names, keys, the vehicle identity columns and the counter columns.
UNITS = "units"
PERSON = "primary_person"
CHARGES = "charges"
DAMAGES = "damages"
ENDORSE = "endorse"
RESTRICT = "restrict"
TABLES = (CHARGES, DAMAGES, ENDORSE, PERSON, UNITS, RESTRICT)

UNIT_KEY = ("crash_id", "unit_nbr")
PERSON_KEY = ("crash_id", "unit_nbr")
CHARGE_KEY = ("crash_id", "unit_nbr", "prsn_nbr")
DAMAGE_KEY = ("crash_id",)
CRASH_KEY = ("crash_id",)

# A vehicle is taken to be identified by these four columns.
VEHICLE_COLS = ("veh_lic_state_id", "vin", "veh_mod_year", "veh_make_id")

# Injury and death counters present on both Units and Primary_Person.
COUNTER_COLS = ("death_cnt", "incap_injry_cnt", "non_injry_cnt", "nonincap_injry_cnt",
                "poss_injry_cnt", "tot_injry_cnt", "unkn_injry_cnt")

# Columns that the questions read, by table.
QUESTION_COLUMNS: dict[str, tuple[str, ...]] = {
    UNITS: (*UNIT_KEY, *VEHICLE_COLS, "veh_color_id", "veh_body_styl_id", "veh_hnr_fl", "fin_resp_type_id",
            "veh_dmag_scl_1_id", "veh_dmag_scl_2_id", "contrib_factr_1_id", "contrib_factr_2_id",
            "contrib_factr_p1_id", "tot_injry_cnt", "death_cnt"),
    PERSON: (*CHARGE_KEY, "prsn_type_id", "prsn_gndr_id", "prsn_injry_sev_id", "prsn_airbag_id",
             "prsn_ethnicity_id", "drvr_lic_cls_id", "drvr_lic_state_id", "drvr_zip", "prsn_alc_rslt_id"),
    CHARGES: (*CHARGE_KEY, "charge"),
    DAMAGES: ("crash_id", "damaged_property"),
}

# Columns with a numeric type; every other column stays a string.
NUMERIC_TYPES: dict[str, T.DataType] = {
    "crash_id": T.LongType(),
    "unit_nbr": T.IntegerType(),
    "prsn_nbr": T.IntegerType(),
    **{c: T.IntegerType() for c in COUNTER_COLS},
}

# The Units columns in file order (37 fields), all text except keys and counters.
UNITS_COLUMNS = (
    "crash_id", "unit_nbr", "unit_desc_id", "veh_parked_fl", "veh_hnr_fl", "veh_lic_state_id",
    "vin", "veh_mod_year", "veh_color_id", "veh_make_id", "veh_mod_id", "veh_body_styl_id",
    "emer_respndr_fl", "ownr_zip", "fin_resp_proof_id", "fin_resp_type_id", "veh_dmag_area_1_id",
    "veh_dmag_scl_1_id", "force_dir_1_id", "veh_dmag_area_2_id", "veh_dmag_scl_2_id",
    "force_dir_2_id", "veh_inventoried_fl", "veh_transp_name", "veh_transp_dest",
    "contrib_factr_1_id", "contrib_factr_2_id", "contrib_factr_p1_id", "veh_trvl_dir_id",
    "first_harm_evt_inv_id", "incap_injry_cnt", "nonincap_injry_cnt", "poss_injry_cnt",
    "non_injry_cnt", "unkn_injry_cnt", "tot_injry_cnt", "death_cnt",
)


def struct_for(columns: tuple[str, ...] | list[str]) -> T.StructType:
    """A schema for the given column names: numeric where listed above, else string."""
    return T.StructType([T.StructField(c, NUMERIC_TYPES.get(c.lower(), T.StringType()), True)
                         for c in columns])


UNITS_SCHEMA = struct_for(UNITS_COLUMNS)
