"""Operator 3 where many documents share a template below the threshold."""

import numpy as np

from crashlens.llm import minhash_dedup
from tests.llm.helpers import near_groups


def template_sets(n, seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    return [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(n)]


def compared_in_full(n, seed):
    sign = minhash_dedup.signatures(template_sets(n, seed))
    bands, sketch = minhash_dedup.band_keys(sign), (sign & np.uint32(0xFF)).astype(np.uint8)
    seen = []
    for key in np.unique(bands):
        ids = np.nonzero((bands == key).any(axis=1))[0]
        twice = np.concatenate([ids, ids])  # members, then probes
        probe = np.arange(len(twice)) >= len(ids)
        found = minhash_dedup.block_candidates(
            key, probe, twice, twice, np.full(len(twice), ids[0]), np.full(len(twice), 400),
            bands[twice], sketch[twice], 80)
        for p, q in found:
            if twice[p] != ids[0]:  # the largest component's members are no probes
                seen += [(int(min(twice[p], x)), int(max(twice[p], x))) for x in twice[q]]
    return seen


def test_templates_compare_few_pairs_in_full():
    """Similarity 0.6 throughout: about a twelfth of all pairs is compared in full (a template's
    own hash makes it more or less), each pair once."""
    n, total = 100, 0
    for seed in range(20):
        seen = compared_in_full(n, seed)
        assert len(seen) == len(set(seen))
        total += len(seen)
    assert total < 0.1 * 20 * n * (n - 1) / 2


def test_no_link_at_the_threshold_is_turned_away():
    rng = np.random.default_rng(5)
    need, kept = minhash_dedup.agreements_needed(80), 0
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = minhash_dedup.signatures([pool[:360], pool[40:]])  # 320 of 400 shared: exactly 0.8
        kept += ((a & 0xFF) == (b & 0xFF)).sum() >= need
    assert kept >= 399


def test_template_groups_equal_brute_force(spark, monkeypatch):
    """A template at about 0.6 with pairs and chains above 0.8 in it, in several small blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    head = " ".join(f"common{i}" for i in range(150))
    texts = {}
    for i in range(120):
        own = " ".join(f"own{i // 3}x{j}" for j in range(48))
        texts[i] = f"{head} {own} " + " ".join(f"end{i}y{j}" for j in range(8 + 6 * (i % 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, k=4).collect()}
    assert got == near_groups(texts, 4, 80)
    assert 1 < len(set(got.values())) < len(got)
