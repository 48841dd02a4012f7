"""Operator 9: sorted windows against plain counts, the routing's shape, recall at the threshold."""

import math

import numpy as np
import pytest

from crashlens.llm import embedding_dedup as op


@pytest.mark.parametrize("counters", [50, 4_000_000])
def test_window_collisions_equal_plain_counts(monkeypatch, counters):
    monkeypatch.setattr(op, "COUNTERS", counters)  # one or many groups at a time
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 12, 90))
    lines = rng.integers(100, 160, (90, op.PROJECTIONS)).astype(np.uint8)
    got = [(int(i), int(j)) for a, b in op.window_collisions(group, lines, 15, 25) for i, j in zip(a, b)]
    wide = lines.astype(int)
    want = [(i, j) for i in range(90) for j in range(i + 1, 90) if group[i] == group[j]
            and (abs(wide[i] - wide[j]) <= 15).sum() >= 25]
    assert want and sorted(got) == want


def test_no_rows_have_no_collisions():
    assert list(op.window_collisions(np.zeros(0, int), np.zeros((0, op.PROJECTIONS), np.uint8), 15, 25)) == []


def test_share_of_unrelated_pairs_that_meet_falls_as_the_table_grows():
    far = op.same_cell(op.CELL_WIDTH * op.distance(0.9), math.sqrt(2))
    shares = []
    for n in (10_000, 1_000_000, 100_000_000):
        dims, rounds = op.routing_shape(n, 0.9)
        assert n * far ** dims <= op.CELL
        shares.append(1 - (1 - far ** dims) ** rounds)
    assert shares[1] < shares[0] / 10 and shares[2] < shares[1] / 10


@pytest.mark.parametrize("dim, shape_of", [(32, 1_000), (64, 200_000), (128, 20_000_000)])
def test_recall_at_the_threshold(dim, shape_of):
    """Pairs at cosine 0.9, with the cells of a table of ``shape_of`` vectors."""
    rng = np.random.default_rng(dim)
    n = 1500
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9001 * x + math.sqrt(1 - 0.9001 ** 2) * z
    ways = op.Directions.of(dim, *op.routing_shape(shape_of, 0.9))
    half, need = op.windows(0.9)
    width = op.CELL_WIDTH * op.distance(0.9)
    meet = (ways.keys(x, width) == ways.keys(y, width)).any(axis=1)
    near = (abs(ways.lines(x).astype(int) - ways.lines(y).astype(int)) <= half).sum(axis=1) >= need
    assert (meet & near).mean() >= 0.9
