"""Brute-force versions and small fixtures."""

from __future__ import annotations

import re

LONG = "word " * 40_000
CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, id long, score double, "
            "key string, path string, tox_score string, lang_pred string, probability string, "
            "is_secret string, piece_ids string, kept string, n string, rep string")


def edge_docs(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows, ties, and
    columns with the names that the operators use themselves."""
    def row(i, t, lang="en"):
        return (i, t, lang, "src", len(t) if t is not None else None, *[None] * 12)

    rows = [row(1, "the same words in the same order for a pair of rows"),
            row(2, "the same words in the same order for a pair of rows"),
            row(3, ""), row(4, None), row(5, " \t\n"), row(None, "a text without an id"),
            row(6, LONG), row(7, "x" * 100_000), row(8, "été 😀 naïve", None), row(8, "été 😀 naïve", None),
            (None,) * 17]
    return spark.createDataFrame(rows, CLASHING)


def empty_docs(spark):
    return spark.createDataFrame([], CLASHING)


def shingles(text: str | None, k: int) -> frozenset:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else (tuple(words[i:i + k]) for i in range(len(words) - k + 1)))


def smallest_reachable(ids, linked) -> dict:
    """Brute force over all pairs: id -> smallest id reachable."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(ids)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if find(a) != find(b) and linked(a, b):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def near_groups(texts: dict, k: int, percent: int) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}

    def linked(a, b):
        inter = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter)

    return smallest_reachable(texts, linked)


def measures(text: str | None) -> tuple:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
