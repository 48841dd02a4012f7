"""The operators against brute force, round trips and held-out accuracy."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from crashlens.llm import (embedding_dedup, language_id, minhash_dedup, queries, quality_ledger, secret_forest,
                           token_matrix, tokens, toxicity_grammar, unigram_pieces, window_packing)
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import helpers

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _texts(spark, sf=SF_SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# Operator 1

def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 256, (5, 4))
    y, mask = np.array([0, 1, 2, 0]), np.ones((5, 4))
    mask[3:, 1] = 0
    _, grad = language_id.gradients(net.p, x, y, mask)
    for k in net.p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = language_id.gradients(net.p, x, y, mask)[0]
        net.p[k][at] = keep - 1e-3
        down = language_id.gradients(net.p, x, y, mask)[0]
        net.p[k][at] = keep
        assert (up - down) / 2e-3 == pytest.approx(grad[k][at], rel=0.05, abs=1e-4), k


def test_windows_cover_whole_texts():
    raw = [b"", b"a", bytes(range(1, 131)), b"x" * 64]
    x, length, owner = language_id.cut_windows(raw)
    for i, r in enumerate(raw):
        assert b"".join(x[:n, j].tobytes() for j, n in enumerate(length) if owner[j] == i) == r


def test_language_accuracy_on_held_out_rows(spark):
    found = queries.op1_language_id(spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    row = found.where("held_out").join(docs, "doc_id").agg(
        F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.95 and row[1] >= 0 and row[2] <= 1


# Operator 3

def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    for n in (1, 5, 60, 400):
        a = np.unique(base[:n])
        b = np.unique(np.concatenate([base[: n - n // 5], rng.integers(0, 1 << 62, n // 5, dtype=np.uint64)]))
        sa, sb = minhash_dedup.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sa == sb).mean() - true) < 0.15
    # each element's offers go to a permutation of all positions: one element fills them all
    one = minhash_dedup.signatures([np.array([7], np.uint64)])[0]
    assert sorted((one >> 25).tolist()) == list(range(len(one)))


def _near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(140):  # one group at very different distances, so that it splits and joins
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[1000 - i] = " ".join(words)
    for i in range(60):
        texts[2000 + i] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 30])))
    texts[3000] = texts[2000].upper()
    return texts


@pytest.mark.parametrize("block", [16, 256])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)  # several blocks to a bucket
    texts = _near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, k=4).collect()}
    assert got == helpers.near_groups(texts, 4, 80)


# Operators 4 and 6

def test_bpe_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    texts = [*_texts(spark).values(), "", " a  b\n\n c ", "<|endoftext|> it's", "😀 ñ\x1c　x", "a <|endoftext|> b",
             "<|endoftext|><|endoftext|>", "x<|endoftext|>  \n y <|endoftext", "a\n\n<|endoftext|>"]
    enc = tokens.encoder(BPE)
    assert [enc.encode(t).tolist() for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    tok.encode_special_tokens = True
    assert [enc.encode(t, special=False).tolist() for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_window_packing_invariants(spark):
    texts = _texts(spark)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pieces = window_packing.pack_documents(docs, BPE).collect()
    enc = tokens.encoder(BPE)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t in texts.items():
        mine = sorted(by_doc[i], key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in mine)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode(t, 1).tolist()
        assert all(p.doc_tokens == len(ids) // 4 for p in mine)
    room = used = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == seq[0].sequence_length <= 2048
        used += at
        room += at if at & (at - 1) == 0 else 2048
    assert used / room > 0.97


def test_window_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        pos = [0]
        while len(pos) < 14:
            pos.append(pos[-1] + rng.randint(1, 9))
        penalty = [0] + [rng.choice([0, 2, 5]) for _ in pos[1:]]

        def cost(cuts):
            before, total = 0, 0
            for c in cuts:
                if c - before > 12:
                    return float("inf")
                total += 12 - (c - before) + penalty[pos.index(c)]
                before = c
            return total

        inner = pos[1:-1]
        best = min(cost([p for i, p in enumerate(inner) if mask >> i & 1] + [pos[-1]]) for mask in range(1 << len(inner)))
        assert cost(window_packing.choose_cuts(np.array(pos), np.array(penalty), 12)) == best
    assert window_packing.trim_tail([2048, 2048 + 1024 + 3], 2048)[-1] == 3075


def test_best_fit_equals_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        lengths = [rng.randint(1, 30) for _ in range(50)]
        rows, rooms = [], []
        for p in sorted(range(50), key=lambda i: (-lengths[i], i)):
            fits = [r for r, room in enumerate(rooms) if room >= lengths[p]]
            if fits:
                r = min(fits, key=lambda r: rooms[r])
            else:
                r = len(rows)
                rows.append([])
                rooms.append(30)
            rows[r].append(p)
            rooms[r] -= lengths[p]
        got = token_matrix.best_fit(lengths, 30)
        assert sorted(30 - sum(lengths[p] for p in r) for r in got) == sorted(rooms)
        assert sorted(p for r in got for p in r) == list(range(50))


def test_token_matrix_is_lossless(spark):
    texts = _texts(spark)
    rows = token_matrix.pack_matrix(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), BPE).collect()
    parts = {}
    for r in rows:
        assert len(r.ids) == 4 * 2048 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for d, s, ids in zip(r.doc_ids, r.doc_starts, token_matrix.unpack_row(bytes(r.ids), r.cu_seqlens)):
            parts.setdefault(d, []).append((s, ids))
    enc = tokens.encoder(BPE)
    for i, t in texts.items():
        assert np.concatenate([x for _, x in sorted(parts[i], key=lambda p: p[0])]).tolist() == enc.encode(t, 50256).tolist()
    assert len({r.sequence_id for r in rows}) == len(rows)


# Operator 5

def test_unigram_total_is_the_best(spark):
    """Against a plain program over a dictionary of the pieces, and never below the total of the
    library's own unigram search (32-bit sums) over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # read the same pieces and scores as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = unigram_pieces.PieceModel(PIECES)
    codec = unigram_pieces.PieceCodec(model)
    score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
    lines = sorted({line[:200] for t in _texts(spark).values() for line in t.split("\n") if line})[:200]

    def best(text):
        total = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 16), e):
                w = score.get(text[s:e], model.unknown if e - s == 1 else None)
                if w is not None:
                    total[e] = max(total[e], total[s] + w)
        return total[-1]

    for text, ids in zip(lines, codec.encode(lines)):
        ours = np.frombuffer(ids, "<u4").astype(int)
        got = model.scores[ours].sum()
        if all(i not in model.byte_ids for i in ours):
            assert got == best("▁" + text.replace(" ", "▁")), text
            assert got >= model.scores[library.encode(text)].sum()


def test_column_and_single_programs_agree(spark):
    codec = unigram_pieces.PieceCodec(unigram_pieces.PieceModel(PIECES))
    words = ["▁" + w for t in list(_texts(spark).values())[:20] for w in t.split()[:100]] + [
        "▁梦の😀x", "▁▁a", "▁", "▁\x00é\n", "▁" + "é" * 20]
    many = codec.segment_many([w.encode() for w in words])
    assert [np.frombuffer(m, "<u4").tolist() for m in many] == [codec.segment_one(w.encode()) for w in words]
    for t in ["", " ", "  a  b ", "\n", "梦の😀x", "x" * 500]:
        assert codec.decode(codec.encode([t])[0]) == t


def test_double_array_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"bcd", "é".encode()]
    trie = unigram_pieces.DoubleArray(keys, list(range(len(keys))))
    base, check, value = trie.arrays

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c
            if t >= len(check) or check[t] != s or t == 0:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"bc") == find(b"x") == find(b"abcd") == -1


# Operator 7

def test_measures_equal_brute_force(spark):
    texts = {1: "a b c a b c", 2: "x y x y x y x", 3: "l\nl\n \n \nm\nl", 4: "# a|b\t<c>\x0bé f", 5: "", 6: None, 7: "a a a a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality_ledger.ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == helpers.measures(texts[r.doc_id])


def test_policies_and_ablations(spark):
    bit = quality_ledger.BIT
    book = spark.createDataFrame([(1, 0), (2, bit["symbols"]), (3, bit["symbols"] | bit["few_words"]), (4, bit["few_words"])],
                                 "doc_id long, failures long")
    assert [r.doc_id for r in quality_ledger.apply_policy(book, 1).where("kept").orderBy("doc_id").collect()] == [1, 2]
    got = {(r.version, r.rule): (r.n_failed, r.n_only) for r in quality_ledger.ablations(book).collect()}
    assert got[1, "few_words"] == (2, 2) and got[2, "few_words"] == (2, 1) and got[2, "symbols"] == (2, 1)
    assert got[2, "capitals"] == (0, 0) and (1, "symbols") not in got


def test_quality_plan_has_no_python(spark):
    for q in (queries.op7_quality_ledger, queries.op2_license_digests):
        plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# Operator 8

def test_grammar_channels():
    g = toxicity_grammar.Grammar({"moron": 5.0}, {"lowei": 3.0}, [-3.0, 1, 1, 1, 1, 1, 1, 1])
    s = toxicity_grammar.Scorer(g)
    names = toxicity_grammar.CHANNELS

    def on(text):
        return {n: v for n, v in zip(names, s.channels(text)) if v and n != "density"}

    assert on("What a moron") == {"plain": 5.0, "hits": 1.0}
    assert on("you are a LOWEIABC!") == {"targeted": 3.0, "hits": 1.0}
    assert on("he is not a moron.") == {"negated": 5.0, "hits": 1.0}
    assert on("she said moron; moron") == {"reported": 5.0, "plain": 5.0, "hits": 2.0}
    assert on("I will kill you") == {"threat": 3.0}
    assert on("never kill you. oxymoron lowei moronic") == {}
    assert s.score("x moron moron") > s.score("x") < 0.5


def test_toxicity_on_held_out_rows(spark):
    got = queries.op8_toxicity_grammar(spark, SF_CHECK)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    rows = got.join(labels, "doc_id").select("score", "toxic", "predicted", "held_out").collect()
    pos = [r.score for r in rows if r.toxic == 1]
    neg = [r.score for r in rows if r.toxic == 0]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.8
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.93


# Operator 9

def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 24))
    x = [b + rng.normal(scale=s, size=24) for b in base for s in (0.0, 0.05, 0.1, 0.2, 0.3)]
    x += [base[0] + rng.normal(scale=0.1, size=24) for _ in range(60)] + [x[3]] * 3 + [7 * x[3]]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] + [1.0] * 23), (None, x[0].tolist()),
           (905, [1e300] * 24), (906, [1e-300] * 24)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(4)
    u = np.array([v for _, v in vectors] + [[1.0] * 24] * 2)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [*range(len(x)), 905, 906]
    rank = {i: n for n, i in enumerate(ids)}
    want = helpers.smallest_reachable(ids, lambda a, b: near[rank[a], rank[b]])
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    found = sum(got[i].n_links for i in ids)
    assert 0.95 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[rank[i]].sum() for i in ids)
    assert np.mean([got[i].component_id == want[i] for i in ids]) > 0.97
    for i in (900, 901, 902, 903, 904, None):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


# Operator 10

def test_secrets_found_and_false_positives_removed(spark):
    found = queries.op10_secret_forest(spark, SF_CHECK).collect()
    texts = _texts(spark, SF_CHECK)
    assert all(texts[r.doc_id][r.start:r.start + len(r.candidate)] == r.candidate for r in found)
    planted = {(i, m) for i, t in texts.items() for m in __import__("re").findall(r'token = "([0-9a-f]{40})"', t)}
    secret = {(r.doc_id, r.candidate) for r in found if r.is_secret}
    assert planted <= secret
    assert all("token" in r.before.lower() for r in found if r.is_secret)


def test_trees_follow_their_splits(spark):
    tree = secret_forest.Node(0.5, "length", 5, secret_forest.Node(0.1),
                              secret_forest.Node(0.5, "digits", 2, secret_forest.Node(0.2), secret_forest.Node(0.9)))
    df = spark.createDataFrame([(3, 9), (8, 1), (8, 9)], "length int, digits int")
    got = df.select(secret_forest.as_condition(tree, lambda n: F.lit(n.share)).alias("p")).collect()
    assert [r.p for r in got] == [0.1, 0.2, 0.9]


def test_redaction_replaces_every_place(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.createDataFrame([(1, f'token = "{key}" and {key}', None), (2, f'token = "{key}" and {key}', "x"), (3, "clean", None)],
                                 "doc_id long, text string, __secrets string").drop("__secrets")
    out = {r.doc_id: r.text for r in secret_forest.redact_secrets(docs, []).collect()}
    assert out == {1: 'token = "[secret]" and [secret]', 2: 'token = "[secret]" and [secret]', 3: "clean"}


# The pipeline

def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    pieces = corpus_pipeline.run(spark, SF_SMALL)
    left = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    groups = helpers.near_groups(docs, 5, 80)
    clean = {i for i in docs if groups[i] == i and labels.get(i) == 0}
    assert clean <= left
    # of each group at most one is left
    kept_groups = [groups[i] for i in left]
    assert len(kept_groups) == len(set(kept_groups))
