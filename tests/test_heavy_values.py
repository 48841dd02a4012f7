"""Heavy values of nearly unique columns against plain counts."""

from collections import Counter

import pytest

from crashlens.operators import heavy_values


def found(df, col, share):
    rows = [(r.value, r.n) for r in heavy_values(df, col, share).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("share", [0.002, 0.01, 0.05, 1.0])
def test_equals_plain_counts(spark, share):
    values = [f"u{i}" for i in range(30_000)] + ["hot"] * 9_000 + [f"w{i % 40}" for i in range(8_000)] + [None] * 3_000
    df = spark.createDataFrame([(v,) for v in values], "vin string").repartition(7)
    counts = Counter(v for v in values if v is not None)
    assert found(df, "vin", share) == {v: n for v, n in counts.items() if n >= share * len(values)}


def test_all_equal_none_and_empty(spark):
    assert found(spark.createDataFrame([(3,)] * 50, "i int"), "i", 1.0) == {3: 50}
    assert found(spark.createDataFrame([(None,)] * 5, "i int"), "i", 0.1) == {}
    assert found(spark.createDataFrame([], "i int"), "i", 0.1) == {}


def test_only_proposed_values_are_shuffled(spark):
    df = spark.range(200_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS `a b`", "1 AS n")
    assert found(df, "a b", 0.3) == {-1: 66_667}
    plan = heavy_values(df, "a b", 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("share", [0, -1, 1.5, 1e-9])
def test_shares_out_of_range_are_refused(spark, share):
    with pytest.raises(ValueError):
        heavy_values(spark.range(3), "id", share)
