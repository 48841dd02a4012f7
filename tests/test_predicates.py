from crashlens.functions.predicates import (grade_above, icontains, icontains_any, ieq,
                                            non_numeric, not_placeholder, null_or_placeholder)


def _flags(spark, values, pred, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    return [r[0] for r in df.orderBy("i").select(pred("c").alias("f")).collect()]


def test_ieq_mixed_case_null_empty_blank(spark):
    assert _flags(spark, ["Male", "MALE", "male ", "", None], lambda c: ieq(c, "male")) == \
        [True, True, False, False, None]


def test_icontains_and_any(spark):
    vals = ["Passenger Car, 2-Door", "POLICE CAR/TRUCK", "pickup", None, ""]
    assert _flags(spark, vals, lambda c: icontains(c, "car")) == [True, True, False, None, False]
    df = spark.createDataFrame([("x", "had been drinking"), ("alcohol", None), (None, None), ("a", "b")],
                               "a string, b string")
    got = [r[0] for r in df.select(icontains_any(["a", "b"], ["ALCOHOL", "DRINKING"])).collect()]
    assert got == [True, True, None, False]


def test_not_placeholder_drops_null_and_words(spark):
    df = spark.createDataFrame([("na",), ("NA",), ("Unknown",), (None,), ("WHITE",), ("",)], "c string")
    kept = [r.c for r in df.where(not_placeholder("c", ["NA", "UNKNOWN"])).collect()]
    assert sorted(kept) == ["", "WHITE"]
    # case-sensitive form keeps the lower-case word
    kept_cs = [r.c for r in df.where(not_placeholder("c", ["NA"], case_insensitive=False)).collect()]
    assert sorted(kept_cs) == ["", "UNKNOWN".title(), "WHITE", "na"]


def test_not_placeholder_empty_list(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert df.where(not_placeholder("c", [])).count() == 1


def test_null_or_placeholder_on_int_column_does_not_fail(spark):
    assert _flags(spark, [1, None, 3], lambda c: null_or_placeholder(c), "int") == [False, True, False]
    assert _flags(spark, ["NA", None, "TX"], lambda c: null_or_placeholder(c)) == [True, True, False]


def test_non_numeric(spark):
    assert _flags(spark, ["98", "TX", "NA", None, " 7 "], non_numeric) == [False, True, True, True, False]
    numbers = ["1.5", ".5", "1.", "-7", "+3", " 12 ", "2147483647.9", "-2147483648"]
    words = ["1e3", "99999999999", "2147483648", "+.", ".", "", "1 2", "1.2.3"]
    assert _flags(spark, numbers + words, non_numeric) == [False] * len(numbers) + [True] * len(words)


def test_grade_above(spark):
    vals = ["DAMAGED 4", "DAMAGED 5", "DAMAGED 7 HIGHEST", "NO DAMAGE", "NA", "INVALID VALUE", None,
            "damaged 6"]
    got = _flags(spark, vals, lambda c: grade_above(c, "DAMAGED 4"))
    assert got == [False, True, True, False, False, False, None, True]


def test_grade_above_two_columns_with_null(spark):
    df = spark.createDataFrame([("DAMAGED 5", None), (None, "DAMAGED 6"), (None, "NA"), ("NA", "DAMAGED 2")],
                               "a string, b string")
    got = [r[0] for r in df.select(grade_above(["a", "b"], "DAMAGED 4")).collect()]
    assert got[0] is True and got[1] is True
    assert not got[2] and not got[3]
    assert df.where(grade_above(["a", "b"], "DAMAGED 4")).count() == 2
