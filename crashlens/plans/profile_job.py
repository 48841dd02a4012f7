"""The exploratory checks of the six incident tables as one profiling job.

For each table: its schema, a preview, one aggregate with row count, exact-copy count, key count and
missing-key count, distinct counts of candidate keys, value counts of its coded columns in long form, the largest unit
numbers, NULL-or-``NA`` counts of the vehicle identity parts, and a sample of deduplicated
vehicles. Every result is a DataFrame; nothing is collected to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from crashlens.operators.dedup import count_entities
from crashlens.operators.profile import (key_counts, largest_keys, missing_counts,
                                         profile_table, sample_entities, schema_rows,
                                         value_counts)
from crashlens.session import apply_scale_conf, staging_path
from crashlens.sources.io import load_tables, preview, result_path, write_result
from crashlens.sources.schemas import (CHARGE_KEY, CHARGES, DAMAGES, ENDORSE, PERSON, RESTRICT,
                                       UNIT_KEY, UNITS, VEHICLE_COLS)

# Candidate keys and the coded columns whose values are listed.
KEYS = {
    CHARGES: CHARGE_KEY,
    DAMAGES: ("crash_id",),
    ENDORSE: UNIT_KEY,
    PERSON: ("crash_id", "unit_nbr", "prsn_nbr"),
    RESTRICT: UNIT_KEY,
    UNITS: UNIT_KEY,
}
CODED_COLUMNS = {
    ENDORSE: ("drvr_lic_endors_id",),
    PERSON: ("prsn_type_id", "prsn_occpnt_pos_id", "prsn_injry_sev_id", "prsn_ethnicity_id",
             "prsn_gndr_id", "prsn_ejct_id", "prsn_rest_id", "prsn_airbag_id", "prsn_helmet_id",
             "prsn_alc_rslt_id", "drvr_lic_type_id", "drvr_lic_state_id", "drvr_lic_cls_id"),
    RESTRICT: ("drvr_lic_restric_id",),
    UNITS: ("unit_desc_id", "veh_hnr_fl", "veh_lic_state_id", "vin", "veh_mod_year", "veh_color_id",
            "veh_make_id", "veh_mod_id", "veh_body_styl_id", "fin_resp_type_id",
            "veh_dmag_scl_1_id", "veh_dmag_scl_2_id", "contrib_factr_1_id", "contrib_factr_2_id",
            "contrib_factr_p1_id", "tot_injry_cnt", "death_cnt"),
}
MISSING_COLUMNS = {UNITS: ("vin", "veh_mod_year")}
CANDIDATE_KEYS = {
    CHARGES: (CHARGE_KEY,),
    PERSON: (UNIT_KEY, ("crash_id", "unit_nbr", "prsn_nbr")),
    UNITS: (UNIT_KEY, ("crash_id", "unit_nbr", "unit_desc_id"), VEHICLE_COLS),
}


def profile_tables(spark: SparkSession, tables: Mapping[str, DataFrame],
                   sample_rows: int = 20) -> dict[str, DataFrame]:
    """``{check name: DataFrame}`` for every table given (any subset of the six)."""
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if df is None:
            continue
        cols = set(df.columns)
        keys = [k for k in KEYS.get(name, ("crash_id",)) if k in cols]
        out[f"{name}_schema"] = schema_rows(spark, df)
        out[f"{name}_preview"] = preview(df, sample_rows)
        if keys:
            out[f"{name}_profile"] = profile_table(df, keys, keys[0])
        candidates = [k for k in CANDIDATE_KEYS.get(name, ()) if set(k) <= cols]
        if candidates:
            out[f"{name}_key_counts"] = key_counts(df, candidates)
        coded = [c for c in CODED_COLUMNS.get(name, ()) if c in cols]
        if coded:
            out[f"{name}_values"] = value_counts(df, coded)
        missing = [c for c in MISSING_COLUMNS.get(name, ()) if c in cols]
        if missing:
            out[f"{name}_missing"] = missing_counts(df, missing)
        if "unit_nbr" in cols:
            out[f"{name}_largest_unit_nbr"] = largest_keys(df, "unit_nbr", sample_rows)
        if name == UNITS and set(VEHICLE_COLS) <= cols:
            out["units_vehicle_count"] = count_entities(df, VEHICLE_COLS)
            out["units_vehicle_sample"] = sample_entities(df, VEHICLE_COLS, sample_rows)
    return out


def write_profiles(profiles: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv",
                   concurrency: int = 4) -> dict[str, str]:
    """Write every check to ``<out_dir>/profile_<name>``, up to ``concurrency`` jobs at a time
    (the checks are small independent aggregates)."""
    def write(name: str) -> str:
        return write_result(profiles[name], result_path(out_dir, f"profile_{name}"), fmt)

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        futures = {name: pool.submit(write, name) for name in profiles}
        return {name: f.result() for name, f in futures.items()}


def run_profile(spark: SparkSession, paths: Mapping[str, str], out_dir: str, in_fmt: str = "csv",
                out_fmt: str = "csv") -> dict[str, str]:
    """Load the tables and write every check to ``<out_dir>/profile_<name>``.

    The session is sized for the input as in the run-all job. Each raw table is parsed once:
    it is written as Parquet to the shared staging folder, and all checks read that.
    """
    apply_scale_conf(spark, list(paths.values()))
    folder = staging_path(spark, uuid.uuid4().hex)
    staged = {}
    for name, df in load_tables(spark, paths, in_fmt).items():
        df.write.parquet(f"{folder}/{name}")
        staged[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    try:
        return write_profiles(profile_tables(spark, staged), out_dir, out_fmt)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
