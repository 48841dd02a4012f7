"""Random inputs with NULLs and repeats, checked against plain-Python brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crashlens.functions.predicates import ieq
from crashlens.operators.dedup import dedup_by_key
from crashlens.operators.groups import groups_with_more_than, groups_without
from crashlens.operators.ranking import top_k_count

SCHEMA = "k long, u int, g string, v string"
row = st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 2)),
                st.sampled_from([None, "Female", "FEMALE", "male", "NA"]),
                st.one_of(st.none(), st.text("abz", max_size=2)))
tables = st.lists(row, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _nulls_last(x):
    return (x is None, x if x is not None else 0)


def _sortkey(r):
    return tuple((x is None, str(x)) for x in r)


@SETTINGS
@given(tables)
def test_dedup_matches_brute_force(spark, data):
    got = sorted((tuple(r) for r in dedup_by_key(spark.createDataFrame(data, SCHEMA), ["k", "u"]).collect()),
                 key=_sortkey)
    best = {}
    for r in data:
        key = (r[0], r[1])
        order = tuple(_nulls_last(x) for x in r[2:])
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    assert got == sorted((v[1] for v in best.values()), key=_sortkey)


@SETTINGS
@given(tables)
def test_group_tests_match_brute_force(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r[2] is not None and r[2].upper() == "FEMALE")
    without = sorted((r.k for r in groups_without(df, "k", ieq("g", "female")).collect()), key=_nulls_last)
    assert without == sorted((k for k, flags in groups.items() if not any(flags)), key=_nulls_last)
    more = sorted(((r.k, r.n) for r in groups_with_more_than(df, "k", ieq("g", "female"), 1, "n").collect()),
                  key=lambda t: _nulls_last(t[0]))
    want = sorted(((k, sum(f)) for k, f in groups.items() if sum(f) > 1), key=lambda t: _nulls_last(t[0]))
    assert more == want


@SETTINGS
@given(tables)
def test_top_k_count_matches_brute_force(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    counts = {}
    for r in data:
        counts[r[3]] = counts.get(r[3], 0) + 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or ""))[:3]
    assert [tuple(r) for r in top_k_count(df, "v", 3, "n").collect()] == want
