"""The ten questions on the incident views of the test tables, against the expected answers
stated in FIXTURES.md §2 (worked out there independently of this code)."""

import os

import pytest

from crashlens.plans import questions as Q
from crashlens.sources.sample_views import sample_incidents

EXPECTED = {
    "/root/testdata/sf0.001": {
        "q1_rows": 7, "q2": 518, "q4": 460, "q9": 104, "q7_rows": 5,
        "q3": [("Brand#24", 11), ("Brand#13", 9), ("Brand#14", 9), ("Brand#22", 9), ("Brand#5", 9)],
        "q5": [("ST19", 64)],
        "q6": [("Brand#22", 384), ("Brand#25", 379), ("Brand#16", 375)],
        "q8": [("78015", 28), ("78019", 28), ("78031", 28), ("78020", 27), ("78036", 26)],
        "q10": [("Brand#13", 45), ("Brand#22", 43), ("Brand#17", 33), ("Brand#4", 33), ("Brand#5", 33)],
    },
    "/root/testdata/sf0.01": {
        "q1_rows": 74, "q2": 9726, "q4": 5784, "q9": 954, "q7_rows": 5,
        "q3": [("Brand#9", 81), ("Brand#17", 76), ("Brand#4", 71), ("Brand#13", 66), ("Brand#2", 66)],
        "q5": [("ST2", 372)],
        "q6": [("Brand#19", 3433), ("Brand#8", 3340), ("Brand#16", 3285)],
        "q7": [("PASSENGER CAR, 4-DOOR", "BLACK", 1159), ("Passenger Car, 2-Door", "BLACK", 1157),
               ("Police Motorcycle", "WHITE", 1130), ("PICKUP", "HISPANIC", 1105), ("MOTORCYCLE", "BLACK", 1102)],
        "q8": [("78022", 215), ("78038", 214), ("78041", 214), ("78003", 212), ("78032", 210)],
        "q10": [("Brand#19", 314), ("Brand#8", 293), ("Brand#2", 279), ("Brand#4", 279), ("Brand#17", 273)],
    },
}


@pytest.mark.parametrize("sf_dir", sorted(EXPECTED))
def test_questions_give_the_stated_answers(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables missing")
    want = EXPECTED[sf_dir]
    t = sample_incidents(spark, sf_dir)
    assert Q.q1(t).count() == want["q1_rows"]
    assert Q.q2_count(t).collect()[0].n == want["q2"]
    assert Q.q4_count(t).collect()[0].n == want["q4"]
    assert Q.q9_count(t).collect()[0].n == want["q9"]
    assert Q.q7(t).count() == want["q7_rows"]
    for name in ("q3", "q5", "q6", "q7", "q8", "q10"):
        if name in want:
            assert [tuple(r) for r in getattr(Q, name)(t).collect()] == want[name], name
