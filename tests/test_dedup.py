from pyspark.sql import functions as F

from crashlens.operators.dedup import count_entities, dedup_by_key, dedup_columns, dedup_where, distinct_entities
from tests.conftest import rows

SCHEMA = "k1 long, k2 int, a string, b int"


def test_exact_copies_collapse(spark):
    df = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "x", 1), (2, 1, "y", 2)], SCHEMA)
    assert rows(dedup_by_key(df, ["k1", "k2"])) == [(1, 1, "x", 1), (2, 1, "y", 2)]


def test_same_key_other_values_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, 1, "z", 1), (1, 1, "b", 9), (1, 1, "b", 3)], SCHEMA)
    assert rows(dedup_by_key(df, ["k1", "k2"])) == [(1, 1, "b", 3)]
    assert rows(dedup_by_key(df, ["k1", "k2"], ["b"])) == [(1, 1, "z", 1)]


def test_null_key_is_one_group(spark):
    df = spark.createDataFrame([(None, 1, "b", 1), (None, 1, "a", 1), (1, None, "c", 1)], SCHEMA)
    assert rows(dedup_by_key(df, ["k1", "k2"])) == [(1, None, "c", 1), (None, 1, "a", 1)]


def test_null_in_first_order_column_goes_last(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (1, 1, "zz", 5)], SCHEMA)
    assert rows(dedup_by_key(df, ["k1", "k2"])) == [(1, 1, "zz", 5)]


def test_shuffled_input_same_answer(spark):
    data = [(k % 7, k % 3, f"v{(k * 37) % 11}", k % 5) for k in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    a = rows(dedup_by_key(df, ["k1", "k2"]))
    b = rows(dedup_by_key(df.repartition(13).orderBy(F.rand(7)), ["k1", "k2"]))
    c = rows(dedup_by_key(spark.createDataFrame(list(reversed(data)), SCHEMA).coalesce(1), ["k1", "k2"]))
    assert a == b == c
    assert len(a) == 21


def test_entity_dedup_nulls_equal_and_na_distinct(spark):
    schema = "id int, s string, v string, y string, m string"
    df = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None),
                                (3, "NA", None, None, None), (4, "TX", "V1", "2007", "FORD")], schema)
    got = rows(distinct_entities(df, ["s", "v", "y", "m"], ["id"]))
    assert [r[0] for r in got] == [1, 3, 4]
    assert count_entities(df, ["s", "v", "y", "m"]).collect()[0].n == 3


def test_all_columns_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "a int, b int")
    assert rows(dedup_by_key(df, ["a", "b"])) == [(1, 1), (2, None)]


def _odd_rows(spark):
    """Repeated and NULL keys, ties in every prefix of the columns, NULLs, whole copies."""
    data = [((k * 7) % 5 or None, k % 2, [None, "a", "b"][k % 3], [None, "x", "X"][k % 7 % 3], k % 4 or None, f"w{k % 11}")
            for k in range(400)]
    return spark.createDataFrame(data, "k1 long, k2 int, a string, b string, c int, wide string")


def test_dedup_columns_equals_the_whole_dedup(spark):
    df = _odd_rows(spark)
    for cols in (["b"], ["A"], ["wide"], ["b", "a"], [], ["k1", "c"]):
        one = dedup_columns(df, ["k1", "k2"], cols)
        assert rows(one) == rows(dedup_by_key(df, ["k1", "k2"]).select(*one.columns))
        assert {c.lower() for c in cols} <= set(one.columns)


def test_dedup_where_equals_the_filter_after_the_dedup(spark):
    df = _odd_rows(spark)
    for cond, reads in ((F.col("b") == "x", ["b"]), (F.col("a") == "b", ["a"]), (F.col("a").isNull(), ["a"]),
                        ((F.col("c") == 3) | (F.col("a") == "a"), ["c", "a"]), (F.col("k2") == 1, []),
                        (F.lit(False), []), (F.col("wide") == "w3", ["wide"])):
        got = dedup_where(df, ["k1", "k2"], cond, reads)
        assert got.columns == df.columns
        assert rows(got) == rows(dedup_by_key(df, ["k1", "k2"]).where(cond))
