import glob
import os

import pytest

from crashlens.operators.joins import join_on, restrict_to
from crashlens.operators.profile import (largest_keys, missing_counts, profile_table,
                                         sample_entities, schema_rows, value_counts)
from crashlens.operators.ranking import top_k_count
from crashlens.sources.io import load_table, load_tables, preview, row_count, write_result
from tests.conftest import rows


def _sides(spark):
    left = spark.createDataFrame([(1, 1, "u", 5)], "crash_id long, unit_nbr int, a string, DEATH_CNT int")
    right = spark.createDataFrame([(1, 1, "p", 7)], "crash_id long, unit_nbr int, b string, death_cnt int")
    return left, right


def test_join_on_collision_modes(spark, tmp_out):
    left, right = _sides(spark)
    with pytest.raises(ValueError):
        join_on(left, right, ["crash_id", "unit_nbr"])
    kept_right = join_on(left, right, ["crash_id", "unit_nbr"], collisions="drop_left")
    assert kept_right.columns == ["crash_id", "unit_nbr", "a", "b", "death_cnt"]
    assert kept_right.collect()[0].death_cnt == 7
    kept_left = join_on(left, right, ["crash_id", "unit_nbr"], collisions="drop_right")
    assert kept_left.collect()[0].DEATH_CNT == 5
    both = join_on(left, right, ["crash_id", "unit_nbr"], collisions="prefix")
    assert both.columns == ["crash_id", "unit_nbr", "a", "DEATH_CNT", "b", "r_death_cnt"]
    # unique names, so a parquet write works
    kept_right.write.parquet(os.path.join(tmp_out, "j"))
    assert spark.read.parquet(os.path.join(tmp_out, "j")).count() == 1


def test_join_on_pairs_keeps_left_key(spark):
    s = spark.createDataFrame([(1, 10), (2, 20)], "s_suppkey long, s_nationkey int")
    n = spark.createDataFrame([(10, "X")], "n_nationkey int, n_name string")
    out = join_on(s, n, [("s_nationkey", "n_nationkey")])
    assert out.columns == ["s_nationkey", "s_suppkey", "n_name"]
    assert rows(out) == [(10, 1, "X")]


def test_restrict_to_is_broadcast_semi_join(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("aabbbcd")], "c string, i int")
    top = top_k_count(df, "c", 2, "n")
    out = restrict_to(df, top, "c")
    assert sorted(r.c for r in out.collect()) == ["a", "a", "b", "b", "b"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastExchange" in plan and "TakeOrderedAndProject" in plan


def test_load_table_csv_header_and_types(spark, tmp_out):
    path = os.path.join(tmp_out, "units.csv")
    with open(path, "w") as f:
        f.write("CRASH_ID,UNIT_NBR,VEH_MOD_YEAR,DEATH_CNT,VEH_COLOR_ID\n")
        f.write("15307513,1,NA,0,BRO\n15307513,2,2007,x,98\n")
    with pytest.raises(Exception, match="column death_cnt: not a int: x"):
        load_table(spark, path).collect()
    df = load_table(spark, path, bad_counters="null")
    assert df.columns == ["crash_id", "unit_nbr", "veh_mod_year", "death_cnt", "veh_color_id"]
    assert dict(df.dtypes) == {"crash_id": "bigint", "unit_nbr": "int", "veh_mod_year": "string",
                               "death_cnt": "int", "veh_color_id": "string"}
    assert rows(df) == [(15307513, 1, "NA", 0, "BRO"), (15307513, 2, "2007", None, "98")]
    tables = load_tables(spark, {"units": path})
    assert tables["units"].count() == 2
    assert load_table(spark, path, bad_counters="null", spread=3).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="no column vin"):
        load_tables(spark, {"units": path}, required={"units": ("crash_id", "vin")})


@pytest.mark.parametrize("bad", ["2x", "99999999999999999999", "1.5"])
def test_malformed_keys_raise_and_never_merge_rows(spark, tmp_out, bad):
    from crashlens.operators.dedup import dedup_by_key
    path = os.path.join(tmp_out, "units.csv")
    with open(path, "w") as f:
        f.write(f"CRASH_ID,UNIT_NBR,VEH_MAKE_ID\n1,1,FORD\n{bad},1,HONDA\n,1,KIA\n")
    df = load_table(spark, path)
    with pytest.raises(Exception, match="column crash_id: not a bigint: " + bad):
        dedup_by_key(df, ["crash_id", "unit_nbr"]).collect()


def test_empty_keys_are_null_keys(spark, tmp_out):
    path = os.path.join(tmp_out, "units.csv")
    with open(path, "w") as f:
        f.write("CRASH_ID,UNIT_NBR,VEH_MAKE_ID\n1,1,FORD\n,1,KIA\n")
    assert rows(load_table(spark, path)) == [(1, 1, "FORD"), (None, 1, "KIA")]


def test_write_result_empty_keeps_header_and_overwrites(spark, tmp_out):
    df = spark.createDataFrame([(1, 3)], "crash_id long, count_of_males_killed long")
    out = os.path.join(tmp_out, "analysis_q1")
    write_result(df, out)
    write_result(df.where("false"), out)
    parts = glob.glob(os.path.join(out, "part-*.csv"))
    text = "".join(open(p).read() for p in parts)
    assert text.strip() == "crash_id,count_of_males_killed"
    write_result(df, os.path.join(tmp_out, "pq"), fmt="parquet")
    assert spark.read.parquet(os.path.join(tmp_out, "pq")).count() == 1


def test_preview_and_row_count(spark):
    df = spark.range(50)
    assert preview(df, 7).count() == 7
    assert row_count(df).collect()[0].n == 50


def test_profile_table(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (None, 2, "c"), (None, 2, "c")],
                               "k1 long, k2 int, v string")
    r = profile_table(df, ["k1", "k2"]).collect()[0]
    assert (r.n_rows, r.n_distinct_rows, r.n_keys, r.n_missing) == (5, 3, 2, 2)


def test_missing_counts_value_counts_schema(spark):
    df = spark.createDataFrame([(1, "NA"), (None, "x"), (3, None), (3, "x")], "i int, s string")
    r = missing_counts(df, ["i", "s"]).collect()[0]
    assert (r.n_missing_i, r.n_missing_s) == (1, 2)
    vc = rows(value_counts(df, ["i", "s"]))
    assert ("i", "3", 2) in vc and ("s", "x", 2) in vc and ("s", None, 1) in vc
    assert [tuple(x) for x in schema_rows(spark, df).collect()] == [("i", "int", True), ("s", "string", True)]
    assert [r.i for r in largest_keys(df, "i", 2).collect()] == [3, 1]
    assert sample_entities(df, ["s"], 10).count() == 3


def test_load_units_with_declared_schema(spark, tmp_out):
    from crashlens.sources.schemas import UNITS_COLUMNS, UNITS_SCHEMA
    good = os.path.join(tmp_out, "units_good.csv")
    with open(good, "w") as f:
        f.write(",".join(c.upper() for c in UNITS_COLUMNS) + "\n")
        f.write(",".join(["1", "2"] + ["X"] * 28 + ["0", "1", "0", "0", "0", "1", "NA"]) + "\n")
    df = load_table(spark, good, schema=UNITS_SCHEMA)
    r = df.collect()[0]
    assert (r.crash_id, r.unit_nbr, r.tot_injry_cnt, r.death_cnt) == (1, 2, 1, None)
    assert len(df.columns) == 37
    bad = os.path.join(tmp_out, "units_bad.csv")
    with open(bad, "w") as f:
        f.write(",".join(["WRONG"] + [c.upper() for c in UNITS_COLUMNS[1:]]) + "\n")
        f.write(",".join(["1", "2"] + ["X"] * 35) + "\n")
    with pytest.raises(Exception):
        load_table(spark, bad, schema=UNITS_SCHEMA).collect()


def test_scale_conf_sizes_partitions(spark, tmp_out):
    from crashlens.session import input_bytes, scale_conf
    tb = 1024 ** 4
    conf = scale_conf(100 * tb, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 204_800
    assert conf["spark.sql.files.minPartitionNum"] == "8000"
    assert int(scale_conf(10 * tb, cores=1000)["spark.sql.shuffle.partitions"]) == 20_480
    assert int(scale_conf(1000, cores=8)["spark.sql.shuffle.partitions"]) == 24
    path = os.path.join(tmp_out, "f.csv")
    with open(path, "w") as f:
        f.write("a\n" * 100)
    assert input_bytes(spark, [path]) == 200
    assert input_bytes(spark, [os.path.join(tmp_out, "*.csv")]) == 200


def test_prefixed_names_stay_unique_and_keys_may_swap(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k int, x int, r_x int")
    right = spark.createDataFrame([(1, 9)], "k int, x int")
    out = join_on(left, right, ["k"], collisions="prefix")
    assert out.columns == ["k", "x", "r_x", "r_r_x"] and rows(out) == [(1, 2, 3, 9)]
    a = spark.createDataFrame([(1, 2, "l")], "a int, b int, v string")
    b = spark.createDataFrame([(2, 1, "r"), (1, 2, "no")], "a int, b int, w string")
    out = join_on(a, b, [("a", "b"), ("b", "a")])
    assert out.columns == ["a", "b", "v", "w"] and rows(out) == [(1, 2, "l", "r")]


def test_semi_join_rows_matches_null_keys(spark):
    from crashlens.operators.joins import semi_join_rows
    wide = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (None, None, "c"), (2, None, "d")], "k int, u int, v string")
    chosen = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 3)], "k int, u int")
    assert sorted(r.v for r in semi_join_rows(wide, chosen, ["k", "u"]).collect()) == ["a", "b", "d"]


def test_profile_of_empty_tables_and_key_counts_plan(spark):
    from crashlens.operators.profile import key_counts
    empty = spark.createDataFrame([], "a int, b int, c int")
    r = profile_table(empty, ["a"]).collect()[0]
    assert (r.n_rows, r.n_distinct_rows, r.n_keys, r.n_missing) == (0, 0, 0, 0)
    keys = [["a", "b"], ["a"], ["c"]]
    assert rows(key_counts(empty, keys)) == [(0, 0, 0, 0)]
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 2, 3), (None, None, 3)], "a int, b int, c int")
    counted = key_counts(df, keys)
    assert rows(counted) == [(4, 3, 2, 2)] and counted.columns == ["n_rows", "n_keys_a_b", "n_keys_a", "n_keys_c"]
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()


def test_sample_entities_is_the_same_for_any_partitioning(spark):
    df = spark.range(500).selectExpr("cast(id % 50 as int) as e", "id as v", "if(id % 7 = 0, null, id % 3) as f")
    base = rows(sample_entities(df, ["f", "e"], 7))
    assert len(base) == 7 and base == rows(sample_entities(df.repartition(9), ["f", "e"], 7))


def test_names_with_a_dot(spark):
    from crashlens.operators.dedup import dedup_by_key
    df = spark.createDataFrame([(1, 5), (1, 4)], ["a.b", "c.d"])
    assert rows(dedup_by_key(df, ["a.b"])) == [(1, 4)]


def test_join_on_right_column_named_like_left_key(spark):
    s = spark.createDataFrame([(1, 10)], "s_suppkey long, s_nationkey int")
    n = spark.createDataFrame([(10, 99, "X")], "n_nationkey int, s_nationkey int, n_name string")
    with pytest.raises(ValueError):
        join_on(s, n, [("s_nationkey", "n_nationkey")])
    out = join_on(s, n, [("s_nationkey", "n_nationkey")], collisions="drop_right")
    assert out.columns == ["s_nationkey", "s_suppkey", "n_name"] and rows(out) == [(10, 1, "X")]
    pre = join_on(s, n, [("s_nationkey", "n_nationkey")], collisions="prefix")
    assert pre.columns == ["s_nationkey", "s_suppkey", "r_s_nationkey", "n_name"]
    assert rows(pre) == [(10, 1, 99, "X")]


def test_load_csv_quoted_commas_and_empty_fields(spark, tmp_out):
    path = os.path.join(tmp_out, "units_q.csv")
    with open(path, "w") as f:
        f.write("CRASH_ID,UNIT_NBR,VEH_BODY_STYL_ID,VEH_TRANSP_DEST,DEATH_CNT\n")
        f.write('1,1,"PASSENGER CAR, 4-DOOR","21822 FRANZ RD. KATY, TX 77449",0\n')
        f.write('2,1,PICKUP,,\n')
    got = rows(load_table(spark, path))
    assert got == [(1, 1, "PASSENGER CAR, 4-DOOR", "21822 FRANZ RD. KATY, TX 77449", 0),
                   (2, 1, "PICKUP", None, None)]
