"""Operators 11 to 13 against plain Python, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashlens.llm import collocations, conversation_trie, decontamination
from tests.llm.helpers import edge_docs, empty_docs

# Operator 11

TURNS = "conv_id long, turn long, role string, text string, parent_conv_id string, bucket string, depth string"


def _rebuilt(rows, every, most):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    if not every:
        return turns
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every if c >= 0 else -(abs(c) % every))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def _trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, ms in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-250, 700), 90), 100, 200, 300]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc é😀"])))
    for c in range(5000, 5060):  # copies of one conversation
        rows += [(c, t, "user", "same") for t in range(3)]
    rows += [(900, t, "user", f"turn {t % 4}") for t in range(120)]  # a long one
    rows += [(901, None, None, None), (901, None, "x", None), (901, 3, None, "y"), (901, 3, None, "y"), (902, -1, "", "")]
    rows += [(None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("every", [None, 100])
def test_trie_equals_brute_force(spark, monkeypatch, every):
    monkeypatch.setattr(conversation_trie, "TOUR_BUCKET", 50)  # several buckets of the tour
    rows = _conversations(3)
    convs = spark.createDataFrame([(*r, "p", "b", "d") for r in rows], TURNS).repartition(7)
    got = conversation_trie.prefix_trie(convs, shared_every=every, shared_most=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == _trie(_rebuilt(rows, every, 6))


def test_trie_of_few_rows(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    one = spark.createDataFrame([(7, None, None, None, "", "", "")], TURNS)
    assert sorted(tuple(r)[:7] for r in conversation_trie.prefix_trie(one).collect()) == [(7, 0, None, 1, 1, 1, 0), (7, 1, 7, 1, 0, 1, 0)]


def test_stretches_of_a_split_tour_are_ranked(spark, tmp_out):
    """A list of arcs dealt over many partitions without any order."""
    from crashlens.llm.common import Staging
    n = 700
    arcs = spark.range(n).select(
        F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("side"),
        *(F.when(F.col("id") < n - 1, x).cast("long").alias(c) for c, x in zip(conversation_trie.NEXT, (F.col("id") + 1, F.lit(0), F.lit(0)))),
        F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")).repartition(13, F.xxhash64("conv_id"))
    staging = Staging(spark, "test-tour")
    placed = staging.write(conversation_trie.contract(staging.write(arcs, "arcs")), "placed")
    left = conversation_trie.rank_stretches(placed.where("last").withColumn("left", F.col("at") + 1), staging)
    rank = placed.join(left, list(conversation_trie.HEAD)).select("conv_id", (F.col("left") - F.col("at")).alias("left"))
    assert sorted(tuple(r) for r in rank.collect()) == [(i, n - i) for i in range(n)]


# Operator 12

def _plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _marked(texts, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = _plain_words(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[j:j + m])].add(i)
    out = []
    for t in texts:
        w, hit, found = _plain_words(t), set(), set()
        for j in range(len(w)):
            for m in range(1, window + 1):
                if tuple(w[j:j + m]) in windows and j + m <= len(w):
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j:j + m])]
        out.append((len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


def _passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "x9"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 7, 10, 11, 30, 90])))) for i in range(25)]
    items += [(30, "the " * 60), (31, None), (32, " -- "), (None, "an item without any id of its own but with words"), (3, items[5][1]), (33, items[5][1])]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts.append(", ".join(w[a:a + rng.choice([5, 10, 40])]).upper())
        texts.append("\n".join(parts))
    return [*texts, None, "", " \t", "the " * 500, "an item, WITHOUT any id of its own but with words!"], items


@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 40)  # long items are cut
    texts, items = _passages(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, [i for a, b in zip(r.spans[::2], r.spans[1::2]) for i in range(a, b)], r["items"])
           for r in decontamination.mark_documents(docs, bench, block_words=block_words).collect()}
    want = _marked(texts, items, 10)
    assert got == dict(enumerate(want)) and 10 < sum(bool(h) for _, h, _ in want) < len(texts)
    report = {r.doc_id: r for r in decontamination.contamination_report(docs, bench, block_words=block_words).collect()}
    for i, (n, hit, found) in enumerate(want):
        r = report[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in enumerate(want) if not w[1]}


def test_longest_matches_equal_brute_force(spark):
    texts, items = _passages(2)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in items if i is not None], "item_id long, text string")
    got = {r.item_id: r for r in decontamination.longest_matches(docs, bench).collect()}
    words = {f"d{i}": _plain_words(t) for i, t in enumerate(texts)}
    best = {}
    for i, t in items:
        w = _plain_words(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            for d in words.values():
                for p in range(len(d)):
                    n = 0
                    while j + n < len(w) and p + n < len(d) and w[j + n] == d[p + n]:
                        n += 1
                    if n >= m and i is not None:
                        best[str(i)] = max(best.get(str(i), 0), n)
    assert {i: r.words for i, r in got.items()} == best
    of = defaultdict(list)
    for i, t in items:
        of[str(i)].append(" ".join(_plain_words(t)))
    for i, r in got.items():
        found = " ".join(words[r.doc_id][r.start:r.start + r.words])
        assert any(f" {found} " in f" {t} " for t in of[i])


def test_suffix_array_of_repeats():
    text = np.array([1, 2, 1, 2, 1, 0, 3, 1, 2, 0, 2, 2, 2, 2, 0, 0], np.int32)
    sa = decontamination.suffix_array(text, 100).tolist()

    def suffix(i):
        return tuple(text[i:i + int(np.argmax(text[i:] == 0))].tolist())
    assert sorted(sa) == [i for i, x in enumerate(text) if x] and [suffix(i) for i in sa] == sorted(map(suffix, sa))


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "the same words in the same order for a pair of rows"), (2, None)], "item_id long, text string")
    got = decontamination.contamination_report(edge_docs(spark), bench).collect()
    assert len(got) == 11 and {r.doc_id for r in got if r.contaminated} == {1, 2}
    assert decontamination.contamination_report(empty_docs(spark), bench).collect() == []
    nothing = decontamination.contamination_report(edge_docs(spark), bench.limit(0)).collect()
    assert len(nothing) == 11 and not any(r.contaminated for r in nothing)
    with pytest.raises(ValueError, match="n_words"):
        decontamination.mark_documents(bench.withColumn("n_words", F.lit(1)), bench)


# Operator 13

def _collocations(rows, support, top, covered=80):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= support}
        found = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            score, cut = min((2_000_000 * a // (f[p[:j]] + f[p[j:]]), j) for j in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in frequent.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _sentences(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "a b", "x", "y", "z"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(30)):
            text += rng.choice([*words, "New York city hall", "z z z z"]) + rng.choice([" ", " ", "\t", ", ", ".\n", "  ", "\x0b"])
        rows.append((i, text, rng.choice(["en", "fr", None])))
    return [*rows, (None, None, "en"), (n, "", "en"), (n + 1, " \t.,", None), (n + 1, "alone", "de")]


@pytest.mark.parametrize(("sample", "lowered", "top"), [(2, 2, 10_000), (1, 30, 10_000), (10**9, 2, 7), (3, 1, 25)])
def test_collocations_equal_brute_force(spark, sample, lowered, top):
    """Whatever the sample proposes (much, all, nothing), the result is exact."""
    rows = _sentences(4, 160)
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    got = collocations.mine_collocations(docs, support=12, top=top, sample=sample, lowered=lowered).collect()
    want = _collocations([(lang, t) for _, t, lang in rows], 12, top)
    assert sorted(tuple(r) for r in got) == want and len(want) > 10


def test_proposals_and_small_filters_never_change_the_counts(spark, monkeypatch):
    from crashlens.llm.common import Staging
    monkeypatch.setattr(collocations, "bits_for", lambda n: 1 << 9)  # most tests of the filter are false hits
    rows = _sentences(5, 120)
    docs = spark.createDataFrame([(lang or "und", t or "") for _, t, lang in rows], "lang string, text string")
    plain = {(r.lang, r.phrase): r.c for r in collocations.frequent_phrases(docs, 9, None, Staging(spark, "t"), few=False).collect()}
    few = {(r.lang, r.phrase): r.c for r in collocations.frequent_phrases(docs, 9, None, Staging(spark, "t"), few=True).collect()}
    assert plain == few and len(plain) > 50


def test_blocks_and_chunks_lose_no_phrase(monkeypatch):
    """Very long texts: counting in small chunks and hashing in small blocks sees every phrase."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"a", b"b", b"longer", b"c."]) for _ in range(n)) for n in (400, 3, 0, 90)]
    every = collocations.Filter(np.full(1 << 8, 255, np.uint8))
    none = collocations.Filter(np.zeros(1 << 8, np.uint8))
    got = Counter()
    for block in collocations.blocks(["en"] * len(texts), texts):
        got.update(collocations.few_phrases(*block, every, none))
    want = Counter()
    for t in texts:
        for piece in t.split(b"."):
            w = piece.split()
            for k in (2, 3, 4):
                want.update(("en", b" ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    assert got == want
    counter = collocations.Counter(every, None, True)
    w = np.concatenate([p for t in texts for p in counter.read("en", t)])
    for size in (len(w), 50):
        got = Counter()
        for first in range(0, len(w), size):
            part = w[first:first + size + 3]
            for _, numbers, _, c in counter.count(part, min(size, len(part))):
                got.update({("en", b" ".join(counter.base[x][1] for x in row)): x for row, x in zip(numbers.tolist(), c.tolist())})
        assert {k: v for k, v in got.items() if b" " in k[1]} == want


def test_words_of_a_counter_are_spelled_as_columns():
    """The phrases of a pass are joined by column, so that no phrase is a Python object of its
    own; new words and a new numbering are followed."""
    counter = collocations.Counter(None, None, True)
    for lang, text in (("en", b"one two"), ("", b"one \xc3\xa9"), ("en", b"three")):
        list(counter.read(lang, text))
        lang_of, led, words = counter.all_words()
        assert words.to_pylist() == [word for _, word in counter.base]
        assert led.to_pylist()[1:] == [x.encode() + b"\t" + word for x, word in counter.base[1:]]
        assert [list(counter.by_lang)[i] for i in lang_of[1:]] == [x for x, _ in counter.base[1:]]
    counter.renumber(np.array([3, 0, 5]))
    assert counter.all_words()[1].to_pylist()[1:] == [b"\tone", b"en\tthree"]


def test_collocations_edge_cases(spark):
    got = collocations.mine_collocations(edge_docs(spark), support=30).collect()
    assert [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r) for r in got] == [("en", 1, "word word word word", 39_997, 40_000, 39_998)]
    assert collocations.mine_collocations(empty_docs(spark)).collect() == []
