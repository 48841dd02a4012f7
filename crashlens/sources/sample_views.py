"""Incident-shaped views over the driver's test tables.

``lineitem``, ``part``, ``orders`` and ``customer`` are put into the shape of the incident
tables so that the ten questions run unchanged on them. Every value is a whole-number rule
of the source columns; a code not listed maps to NULL on purpose. ``(l_orderkey,
l_linenumber)`` repeats with different rows, so the keyed dedup is really exercised.

The views are plain projections and joins: Catalyst prunes the scans to the columns used
and the planner picks the join strategy by size (broadcast only under its size threshold).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.plans.tables import Incidents


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _code(expr: Column, mapping: dict[int, str], default: Column | None = None) -> Column:
    """``CASE expr WHEN k THEN v ... ELSE default END`` (default NULL)."""
    out = None
    for k, v in mapping.items():
        out = F.when(expr == k, F.lit(v)) if out is None else out.when(expr == k, F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def _txt(prefix: str, expr: Column) -> Column:
    return F.concat(F.lit(prefix), expr.cast("string"))


# The code words each view column maps to.
BODY_STYLES = {0: "PASSENGER CAR, 4-DOOR", 1: "Passenger Car, 2-Door", 2: "PICKUP",
               3: "MOTORCYCLE", 4: "Police Motorcycle", 5: "UNKNOWN"}
GRADES_1 = {7: "DAMAGED 7 HIGHEST", 8: "NO DAMAGE", 9: "NA", 10: "INVALID VALUE"}
GRADES_2 = {0: "DAMAGED 6", 1: "NO DAMAGE", 2: "NA"}
FACTORS_1 = {0: "UNDER INFLUENCE - ALCOHOL", 1: "Had Been Drinking"}
PERSON_TYPES = {0: "PASSENGER/OCCUPANT", 1: "Driver of Motorcycle Type Vehicle"}
GENDERS = {0: "FEMALE", 1: "Male", 2: "UNKNOWN", 3: "MALE"}
SEVERITIES = {0: "KILLED", 1: "NOT INJURED"}
AIRBAGS = {0: "NOT DEPLOYED"}
ETHNICITIES = {0: "WHITE", 1: "BLACK", 2: "HISPANIC", 3: "NA", 4: "UNKNOWN"}
LICENCE_CLASSES = {0: "CLASS C", 1: "OTHER/OUT OF STATE", 2: "UNLICENSED"}
CHARGES = {0: "SPEEDING - 10% OVER", 1: "Unsafe Speed"}
PROPERTIES = {0: "NONE", 1: "No Damages to Pole", 2: "FENCE", 3: "MAILBOX"}


def sample_units(spark: SparkSession, sf_dir: str, li: DataFrame | None = None,
                 part: DataFrame | None = None) -> DataFrame:
    li = li if li is not None else _read(spark, sf_dir, "lineitem")
    part = part if part is not None else _read(spark, sf_dir, "part")
    qty = F.col("l_quantity").cast("int")
    disc = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    supp40 = F.col("l_suppkey") % 40
    part14 = F.col("l_partkey") % 14
    return (li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_orderkey").alias("crash_id"),
        F.col("l_linenumber").alias("unit_nbr"),
        _code(supp40, {0: "NA", 1: "98"}, _txt("S", supp40)).alias("veh_lic_state_id"),
        _txt("V", F.col("l_partkey")).alias("vin"),
        F.when(F.col("p_size") == 1, F.lit("NA"))
         .otherwise((F.lit(1970) + F.col("p_size")).cast("string")).alias("veh_mod_year"),
        F.col("p_brand").alias("veh_make_id"),
        _code(part14, {12: "NA", 13: "99"}, _txt("C", part14)).alias("veh_color_id"),
        _code(F.col("l_partkey") % 7, BODY_STYLES).alias("veh_body_styl_id"),
        F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("veh_hnr_fl"),
        F.when(F.col("l_linestatus") == "F", "LIABILITY INSURANCE POLICY")
         .otherwise("SURETY BOND").alias("fin_resp_type_id"),
        _code(qty % 11, GRADES_1, _txt("DAMAGED ", qty % 11)).alias("veh_dmag_scl_1_id"),
        _code(qty % 5, GRADES_2).alias("veh_dmag_scl_2_id"),
        _code(disc, FACTORS_1, F.lit("NONE")).alias("contrib_factr_1_id"),
        _code(tax, {0: "ALCOHOL"}, F.lit("NA")).alias("contrib_factr_2_id"),
        F.lit("NA").alias("contrib_factr_p1_id"),
        (qty % 4).alias("tot_injry_cnt"),
        F.when(qty % 10 == 0, 1).otherwise(0).alias("death_cnt"),
    ))


def sample_persons(spark: SparkSession, sf_dir: str, li: DataFrame | None = None,
                   orders: DataFrame | None = None, cust: DataFrame | None = None) -> DataFrame:
    li = li if li is not None else _read(spark, sf_dir, "lineitem")
    orders = orders if orders is not None else _read(spark, sf_dir, "orders")
    cust = cust if cust is not None else _read(spark, sf_dir, "customer")
    qty = F.col("l_quantity").cast("int")
    zip50 = F.col("o_custkey") % 50
    return (li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
            .join(cust, F.col("o_custkey") == cust.c_custkey, "inner").select(
        F.col("l_orderkey").alias("crash_id"),
        F.col("l_linenumber").alias("unit_nbr"),
        (F.lit(1) + F.col("l_partkey") % 2).cast("int").alias("prsn_nbr"),
        _code(F.col("l_suppkey") % 5, PERSON_TYPES, F.lit("DRIVER")).alias("prsn_type_id"),
        _code(F.col("l_partkey") % 5, GENDERS).alias("prsn_gndr_id"),
        _code(qty % 3, SEVERITIES, F.lit("NA")).alias("prsn_injry_sev_id"),
        _code(qty % 2, AIRBAGS, F.lit("DEPLOYED, FRONT")).alias("prsn_airbag_id"),
        _code(F.col("o_custkey") % 6, ETHNICITIES).alias("prsn_ethnicity_id"),
        _code(F.col("l_suppkey") % 4, LICENCE_CLASSES).alias("drvr_lic_cls_id"),
        _txt("ST", F.col("c_nationkey")).alias("drvr_lic_state_id"),
        F.when(zip50 == 0, F.lit("UNKNOWN")).when(zip50 == 1, F.lit(None).cast("string"))
         .otherwise((F.lit(78000) + zip50).cast("string")).alias("drvr_zip"),
        F.when(F.col("o_orderstatus") == "F", "Positive").otherwise("NA").alias("prsn_alc_rslt_id"),
        (qty % 3).alias("tot_injry_cnt"),
        F.when(qty % 3 == 0, 1).otherwise(0).alias("death_cnt"),
    ))


def sample_charges(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    return (li if li is not None else _read(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("crash_id"),
        F.col("l_linenumber").alias("unit_nbr"),
        (F.lit(1) + F.col("l_partkey") % 2).cast("int").alias("prsn_nbr"),
        _code(F.col("l_suppkey") % 3, CHARGES, F.lit("NO DRIVER LICENSE")).alias("charge"),
        _txt("CIT", F.col("l_suppkey")).alias("citation_nbr"),
    )


def sample_damages(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    return (li if li is not None else _read(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("crash_id"),
        _code(F.col("l_partkey") % 5, PROPERTIES).alias("damaged_property"),
    )


def sample_incidents(spark: SparkSession, sf_dir: str) -> Incidents:
    """The four incident tables the questions read, built from the test tables.

    Each source table is read once (one footer read) and shared by the views that use it.
    """
    li = _read(spark, sf_dir, "lineitem")
    return Incidents(units=sample_units(spark, sf_dir, li),
                     primary_person=sample_persons(spark, sf_dir, li),
                     charges=sample_charges(spark, sf_dir, li),
                     damages=sample_damages(spark, sf_dir, li))
