"""Every question and operator as a query over the test tables: ``(spark, sf_dir) -> DataFrame``.

Each runs over the whole tables; the SQL twin of each key is in
:mod:`crashlens.plans.oracle_sql`. Computed columns carry the same names on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.predicates import (grade_above, icontains, icontains_any, ieq,
                                            non_numeric, not_placeholder)
from crashlens.operators.dedup import count_entities, dedup_by_key, distinct_entities
from crashlens.operators.groups import (conditional_count, count_distinct_by, count_distinct_ids, group_count,
                                        group_sum, groups_with_more_than, groups_without)
from crashlens.operators.joins import join_on, restrict_to
from crashlens.operators.profile import (heavy_values, key_counts, largest_keys, missing_counts, profile_table,
                                         sample_entities, value_counts)
from crashlens.operators.ranking import deep_rank_band, rank_band, top_k, top_per_group
from crashlens.plans import questions as Q
from crashlens.session import staging_path
from crashlens.sources.io import load_checked
from crashlens.sources.sample_views import sample_incidents

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _question(fn) -> Query:
    return lambda spark, sf_dir: fn(sample_incidents(spark, sf_dir))


def _lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_on(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"), [("l_partkey", "p_partkey")])


def _brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per brand (``p_brand, n_lines``). Lines are counted per part first (partial
    aggregation inside each task), so only one count per part meets ``part`` in the join,
    not every line."""
    per_part = group_count(_t(spark, sf_dir, "lineitem"), "l_partkey", "n_lines")
    with_brand = join_on(per_part, _t(spark, sf_dir, "part"), [("l_partkey", "p_partkey")])
    return group_sum(with_brand, "p_brand", "n_lines", "n_lines")


# Texts at the edge of what counts as a number.
ODD_CODES = ("1.5", ".5", "1.", "1e3", " 12 ", "99999999999", "-7", "+.", "")


def _coded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed code column: the size as text, the word ``na``, the brand, or one of a few
    number-like texts."""
    size3 = F.col("p_size") % 3
    code = (F.when(size3 == 0, F.col("p_size").cast("string"))
            .when(size3 == 1, F.lit("na")).otherwise(F.col("p_brand")))
    for i, text in enumerate(ODD_CODES):
        code = F.when(F.col("p_partkey") % 29 == i, F.lit(text)).otherwise(code)
    return _t(spark, sf_dir, "part").select(code.alias("code"))


def q_dedup_by_key(spark, sf_dir):
    return dedup_by_key(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_distinct_entities(spark, sf_dir):
    return distinct_entities(_t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], ["p_partkey"])


def q_count_entities(spark, sf_dir):
    return count_entities(_t(spark, sf_dir, "part"), ["p_brand", "p_type"])


def q_groups_with_more_than(spark, sf_dir):
    return groups_with_more_than(_t(spark, sf_dir, "lineitem"), "l_orderkey",
                                 ieq("l_returnflag", "R"), 2, "n_flagged")


def q_groups_without(spark, sf_dir):
    return groups_without(_t(spark, sf_dir, "lineitem"), "l_orderkey", ieq("l_returnflag", "R"))


def _with_customer(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_on(df, _t(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])


def q_conditional_count(spark, sf_dir):
    # Orders are counted per customer first, so only one row per customer meets customer.
    per_customer = conditional_count(_t(spark, sf_dir, "orders"), "o_custkey",
                                     icontains("o_orderpriority", "urgent"), "n_urgent")
    return group_sum(_with_customer(per_customer, spark, sf_dir), "c_mktsegment", "n_urgent", "n_urgent")


def q_top_k_count(spark, sf_dir):
    return top_k(_brand_lines(spark, sf_dir), "n_lines", 5, "p_brand")


def q_count_distinct_ids(spark, sf_dir):
    """Orders with a line of each return flag and line status, by bitmaps."""
    return count_distinct_ids(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", "n_orders")


def q_top_k_distinct(spark, sf_dir):
    # Distinct ordering customers first (partial aggregation), then their nation.
    buyers = _t(spark, sf_dir, "orders").select("o_custkey").distinct()
    ocn = join_on(_with_customer(buyers, spark, sf_dir), _t(spark, sf_dir, "nation"),
                  [("c_nationkey", "n_nationkey")])
    return top_k(count_distinct_by(ocn, "n_name", "o_custkey", "n_customers"), "n_customers", 5, "n_name")


def q_group_sum(spark, sf_dir):
    return group_sum(_t(spark, sf_dir, "lineitem"), "l_returnflag",
                     F.col("l_quantity").cast("bigint") + F.col("l_linenumber"), "total")


def q_rank_band(spark, sf_dir):
    return rank_band(_brand_lines(spark, sf_dir), "n_lines", 3, 5, "p_brand")


def q_deep_rank_band(spark, sf_dir):
    """The middle of all lines by price, by ranks over ranges."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return deep_rank_band(lines, "l_extendedprice", 5_001, 6_000, ["l_orderkey", "l_linenumber"])


def _orders_as_csv(spark: SparkSession, sf_dir: str) -> str:
    """The orders as a folder of CSV files of two column orders, by Spark's own writer. In the
    second kind, priorities of every fifth order hold an unquoted separator, so that the record
    has a field too many."""
    o = _t(spark, sf_dir, "orders")
    folder = staging_path(spark, uuid.uuid4().hex)
    cols = [F.col("o_orderkey").alias("CRASH_ID"), F.col("o_custkey").alias("UNIT_NBR"), F.col("o_orderstatus").alias("STATUS")]
    plain = o.where(F.col("o_custkey") % 2 == 0).select(*cols, F.col("o_orderpriority").alias("PRIORITY"))
    priority = F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderpriority", F.lit(",torn"))).otherwise(F.col("o_orderpriority"))
    torn = o.where(F.col("o_custkey") % 2 == 1).select(
        F.concat_ws(",", priority, "o_orderstatus", "o_custkey", "o_orderkey").alias("PRIORITY,STATUS,UNIT_NBR,CRASH_ID"))
    plain.write.option("header", "true").csv(f"{folder}/csv")
    # Whole lines as one column whose name is the header; no value holds this separator.
    torn.write.option("header", "true").option("sep", "\x01").mode("append").csv(f"{folder}/csv")
    return f"{folder}/csv"


def q_csv_good_records(spark, sf_dir):
    """Orders that come back from such files, aligned by name."""
    good = load_checked(spark, _orders_as_csv(spark, sf_dir)).good
    return good.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("crash_id").alias("sum_keys"),
                                                  F.sum("unit_nbr").cast("long").alias("sum_units"))


def q_csv_rejected_records(spark, sf_dir):
    """Records of such files that do not fit their header."""
    return load_checked(spark, _orders_as_csv(spark, sf_dir)).rejected.select("reason", "text")


def q_top_per_group(spark, sf_dir):
    per_customer = group_count(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "n_orders")
    counted = group_sum(_with_customer(per_customer, spark, sf_dir), ["c_mktsegment", "o_orderpriority"],
                        "n_orders", "n_orders")
    return top_per_group(counted, "c_mktsegment", "n_orders", "o_orderpriority")


def q_restrict_to_top(spark, sf_dir):
    top = top_k(_brand_lines(spark, sf_dir), "n_lines", 10, "p_brand")
    return group_count(restrict_to(_lp(spark, sf_dir), top, "p_brand"), "l_returnflag", "n_lines")


def q_icontains_any(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(icontains_any(["p_name", "p_type"], ["blue", "widget"]))


def q_not_placeholder(spark, sf_dir):
    coded = _coded_parts(spark, sf_dir)
    return group_count(coded.where(not_placeholder("code", ["NA", "UNKNOWN"])), "code", "n")


def q_non_numeric(spark, sf_dir):
    coded = _coded_parts(spark, sf_dir)
    return group_count(coded.where(non_numeric("code")), "code", "n")


def q_grade_above(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return group_count(orders.where(grade_above("o_orderpriority", "2-HIGH", exclude=["5-LOW"])),
                       "o_orderpriority", "n_orders")


def q_join_on(spark, sf_dir):
    return join_on(_t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation"), [("s_nationkey", "n_nationkey")])


def _collision_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier and customer under shared names, keyed by nation (one customer per nation)."""
    left = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"),
                                                F.col("s_name").alias("name"), F.lit("s").alias("r_name"))
    right = (_t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
             .agg(F.min("c_custkey").alias("id"), F.min("c_name").alias("name"), F.count("*").alias("n")))
    return left, right


def q_join_on_collision(spark, sf_dir):
    left, right = _collision_sides(spark, sf_dir)
    return join_on(left, right, ["nation"], collisions="drop_left")


def q_join_on_prefix(spark, sf_dir):
    left, right = _collision_sides(spark, sf_dir)
    return join_on(left, right, ["nation"], collisions="prefix")


def q_sample_entities(spark, sf_dir):
    return sample_entities(_t(spark, sf_dir, "part").select("p_brand", "p_size", "p_name", "p_partkey"), ["p_brand", "p_size"], 20)


def q_three_way_join(spark, sf_dir):
    # Lines meet their order, are counted per (part, status), and only those counts meet part.
    lo = join_on(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), [("l_orderkey", "o_orderkey")])
    per_part = group_count(lo, ["l_partkey", "o_orderstatus"], "n_lines")
    lpo = join_on(per_part, _t(spark, sf_dir, "part"), [("l_partkey", "p_partkey")])
    return group_sum(lpo, ["p_brand", "o_orderstatus"], "n_lines", "n_lines")


def q_profile_table(spark, sf_dir):
    return profile_table(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_orderkey")


def q_key_counts(spark, sf_dir):
    return key_counts(_t(spark, sf_dir, "lineitem"),
                      [["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey"]])


def q_missing_counts(spark, sf_dir):
    return missing_counts(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], ["NA", "R"])


def q_value_counts(spark, sf_dir):
    return value_counts(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def q_profile_units(spark, sf_dir):
    return profile_table(sample_incidents(spark, sf_dir).units, ["crash_id", "unit_nbr"], "crash_id")


def q_value_counts_units(spark, sf_dir):
    return value_counts(sample_incidents(spark, sf_dir).units,
                        ["veh_body_styl_id", "veh_color_id", "veh_dmag_scl_1_id", "tot_injry_cnt"])


def q_heavy_values(spark, sf_dir):
    return heavy_values(_t(spark, sf_dir, "lineitem"), "l_partkey", min_share=0.0005)


def q_largest_keys(spark, sf_dir):
    return largest_keys(_t(spark, sf_dir, "lineitem"), "l_orderkey", 20)


QUESTION_QUERIES: dict[str, Query] = {
    "q1": _question(Q.q1),
    "q2": _question(Q.q2_count),
    "q2_rows": _question(Q.q2),
    "q3": _question(Q.q3),
    "q4": _question(Q.q4_count),
    "q4_rows": _question(Q.q4),
    "q5": _question(Q.q5),
    "q6": _question(Q.q6),
    "q7": _question(Q.q7),
    "q8": _question(Q.q8),
    "q9": _question(Q.q9_count),
    "q9_rows": _question(Q.q9),
    "q10": _question(Q.q10),
    "q9_any_damage": _question(lambda t: Q.q9_count(t, damage_match="any")),
    "q10_any_charge": _question(lambda t: Q.q10(t, charge_match="any")),
}

OPERATOR_QUERIES: dict[str, Query] = {
    "dedup_by_key": q_dedup_by_key,
    "distinct_entities": q_distinct_entities,
    "count_entities": q_count_entities,
    "groups_with_more_than": q_groups_with_more_than,
    "groups_without": q_groups_without,
    "conditional_count": q_conditional_count,
    "top_k_count": q_top_k_count,
    "top_k_distinct": q_top_k_distinct,
    "count_distinct_ids": q_count_distinct_ids,
    "group_sum": q_group_sum,
    "rank_band": q_rank_band,
    "deep_rank_band": q_deep_rank_band,
    "csv_good_records": q_csv_good_records,
    "csv_rejected_records": q_csv_rejected_records,
    "top_per_group": q_top_per_group,
    "restrict_to_top": q_restrict_to_top,
    "icontains_any": q_icontains_any,
    "not_placeholder": q_not_placeholder,
    "non_numeric": q_non_numeric,
    "grade_above": q_grade_above,
    "join_on": q_join_on,
    "join_on_collision": q_join_on_collision,
    "join_on_prefix": q_join_on_prefix,
    "sample_entities": q_sample_entities,
    "three_way_join": q_three_way_join,
    "profile_table": q_profile_table,
    "key_counts": q_key_counts,
    "missing_counts": q_missing_counts,
    "value_counts": q_value_counts,
    "profile_units": q_profile_units,
    "value_counts_units": q_value_counts_units,
    "largest_keys": q_largest_keys,
    "heavy_values": q_heavy_values,
}

QUERIES: dict[str, Query] = {**QUESTION_QUERIES, **OPERATOR_QUERIES}
