"""Connected components: results and numbers of rounds on chains and awkward tables."""

import math
import random

import pytest

from crashlens.llm.common import Staging
from crashlens.llm.components import connected_components


def components(spark, links):
    rounds = []
    table = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.comp for r in connected_components(table, Staging(spark, "test-components"), rounds).collect()}
    return found, len(rounds)


N = 256
CHAINS = {
    "rising": list(range(N)),
    "falling after the smallest": [0, *range(N - 1, 0, -1)],
    "random": random.Random(3).sample(range(N), N),
    "bit-reversed": [int(f"{i:08b}"[::-1], 2) for i in range(N)],
}


@pytest.mark.parametrize("name", CHAINS)
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, name):
    ids = CHAINS[name]
    found, rounds = components(spark, list(zip(ids, ids[1:])))
    assert found == dict.fromkeys(range(N), 0)
    assert rounds <= 2 * math.log2(N) + 4


def test_several_components_and_awkward_links(spark):
    links = [(5, 3), (3, 5), (3, 5), (3, 9), (7, 7), (None, 1), (2, None), (-4, 12), (100, 12), (50, 51), (51, 52), (52, 50)]
    found, _ = components(spark, links)
    assert found == {3: 3, 5: 3, 9: 3, -4: -4, 12: -4, 100: -4, 50: 50, 51: 50, 52: 50}
    assert components(spark, [])[0] == {}


def test_hot_id(spark):
    found, rounds = components(spark, [(1000, i) for i in range(1000)] + [(1000, i) for i in range(1001, 2000)])
    assert found == dict.fromkeys(range(2000), 0) and rounds <= 4
