import pytest
from pyspark.sql import functions as F

from crashlens.functions.predicates import ieq
from crashlens.operators.groups import (conditional_count, count_distinct_by, count_distinct_ids, group_count,
                                        group_sum, groups_with_more_than, groups_without)
from crashlens.operators.ranking import rank_band, top_k, top_k_count, top_per_group
from tests.conftest import rows


def test_groups_without_keeps_all_null_group_drops_matching(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "Female"), (2, "MALE"), (3, "MALE")],
                               "crash long, g string")
    got = rows(groups_without(df, "crash", ieq("g", "FEMALE")))
    assert got == [(1,), (3,)]


def test_groups_with_more_than(spark):
    df = spark.createDataFrame([(1, "MALE")] * 3 + [(2, "male")] * 2 + [(3, "FEMALE")] * 5,
                               "crash long, g string")
    assert rows(groups_with_more_than(df, "crash", ieq("g", "MALE"), 2, "n")) == [(1, 3)]
    assert rows(groups_with_more_than(df, "crash", ieq("g", "MALE"), 1, "n")) == [(1, 3), (2, 2)]


def test_conditional_count_null_is_not_true(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "k string, v string")
    assert rows(conditional_count(df, "k", F.col("v") == "x", "n")) == [("a", 1), ("b", 0)]


def test_group_sum_and_distinct(spark):
    df = spark.createDataFrame([("a", 1, 2, 10), ("a", None, 2, 10), ("a", 3, 4, 11), ("b", None, 1, None)],
                               "k string, x int, y int, c long")
    assert rows(group_sum(df, "k", F.col("x") + F.col("y"), "s")) == [("a", 10), ("b", None)]
    assert rows(count_distinct_by(df, "k", "c", "n")) == [("a", 2), ("b", 0)]


def test_top_k_tie_at_border_and_fewer_groups(spark):
    df = spark.createDataFrame([("B", 5), ("A", 5), ("C", 5), ("D", 9), (None, 9)], "g string, n long")
    assert [tuple(r) for r in top_k(df, "n", 3, "g").collect()] == [("D", 9), (None, 9), ("A", 5)]
    assert len(top_k(df, "n", 10, "g").collect()) == 5


def test_top_k_count_null_group(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",), ("y",), ("y",)], "g string")
    assert [tuple(r) for r in top_k_count(df, "g", 2, "count").collect()] == [("y", 2), (None, 2)]


def test_rank_band(spark):
    df = spark.createDataFrame([(c, n) for c, n in zip("ABCDEFG", [7, 6, 6, 5, 4, 3, 1])], "g string, n long")
    assert [tuple(r) for r in rank_band(df, "n", 3, 5, "g").collect()] == [("C", 6), ("D", 5), ("E", 4)]
    assert rank_band(df.limit(2), "n", 3, 5, "g").count() == 0


def test_top_per_group_ties(spark):
    df = spark.createDataFrame([("car", "WHITE", 3), ("car", "BLACK", 3), ("van", "ASIAN", 1),
                                ("van", "WHITE", 2), (None, "X", 1)], "s string, e string, n long")
    assert rows(top_per_group(df, "s", "n", "e")) == [("car", "BLACK", 3), ("van", "WHITE", 2), (None, "X", 1)]


def test_group_count(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert rows(group_count(df, "g")) == [("a", 2), (None, 1)]


def test_deep_rank_band_equals_brute_force_and_merges_nothing_in_one_task(spark):
    from crashlens.operators.ranking import deep_rank_band, global_ranks
    df = spark.range(5000).selectExpr("id", "if(id % 11 = 0, null, id * 7919 % 300) as n").repartition(6)
    want = sorted(((r.id, r.n) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for first, last in ((1, 3), (2400, 2600), (4990, 6000), (1, 5000), (5001, 5002)):
        got = [(r.id, r.n) for r in deep_rank_band(df, "n", first, last, "id").collect()]
        assert got == want[first - 1:last], (first, last)
    ranks = {r.id: r["rank"] for r in global_ranks(df, "n", "id").collect()}
    assert ranks == {i: k + 1 for k, (i, _) in enumerate(want)}
    assert deep_rank_band(df.limit(0), "n", 1, 5, "id").collect() == []
    band = deep_rank_band(df, "n", 2400, 2600, "id")
    plan = band._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in plan and "TakeOrderedAndProject" not in plan
    # The only single-task step counts ranges: one row each.
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert len(single) <= 1


def test_distinct_ids_by_bitmap(spark):
    big = 2**63 - 1
    ids = [None, 0, -1, 1, 1, 32767, 32768, 32769, -32768, -32769, big, -big - 1, big, 5 * 10**9]
    data = [("a", i) for i in ids] + [("b", None), ("b", None), (None, 7), (None, 7), (None, -7)]
    df = spark.createDataFrame(data, "k string, i long").withColumn("__x", F.lit(1))
    want = rows(count_distinct_by(df, "k", "i", "n"))
    assert rows(count_distinct_ids(df, "k", "i", "n")) == want
    assert ("a", 11) in want and ("b", 0) in want and (None, 2) in want
    assert rows(count_distinct_ids(df.withColumn("i", F.expr("try_cast(i AS smallint)")), ["k", "__x"], "i", "n")) == rows(
        count_distinct_by(df.withColumn("i", F.expr("try_cast(i AS smallint)")), ["k", "__x"], "i", "n"))
    assert rows(count_distinct_ids(df.limit(0), "k", "i", "n")) == []
    with pytest.raises(TypeError, match="whole-number"):
        count_distinct_ids(df, "i", "k", "n")
