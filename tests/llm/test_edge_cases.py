"""Every operator on nulls, empty and very long texts, repeated rows, clashing column names and
empty tables, and every pipeline stage on them."""

import public_tokenizers
import pytest

from crashlens.llm import (language_id, license_scan, minhash_dedup, quality_ledger, secret_forest, token_matrix,
                           toxicity_grammar, unigram_pieces, window_packing)
from tests.llm.helpers import LONG, edge_docs, empty_docs, near_groups

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_language_id(spark):
    docs = edge_docs(spark)
    net = language_id.learn_languages(docs, per_label=5)
    assert net.langs == ["en"]
    got = sorted(((r.doc_id, r.lang_pred, r.lang_score) for r in language_id.identify_language(docs, net).collect()), key=str)
    assert len(got) == 11
    by_id = {g[0]: g for g in got if g[0] is not None}
    assert by_id[3][1:] == by_id[4][1:] == by_id[5][1:] == ("und", 0.0)
    assert by_id[6][1] == by_id[7][1] == "en" and 0 <= by_id[6][2] <= 1
    assert {r.lang_pred for r in language_id.identify_language(docs, None).collect()} == {"und"}
    assert language_id.learn_languages(empty_docs(spark)) is None
    assert language_id.identify_language(empty_docs(spark), net).collect() == []


def test_licenses(spark):
    extra = spark.createDataFrame([(20, "LICENSED under the *Apache* Licence,\tversion 2.0"), (20, "Released under the MIT License.")],
                                  "doc_id long, text string")
    docs = edge_docs(spark).select("doc_id", "text").union(extra)
    got = sorted((r.doc_id, r.unit, r.license) for r in license_scan.scan_licenses(docs).collect())
    assert got == sorted([(20, u, n) for u in ("text", "paragraphs", "line") for n in ("Apache-2.0 notice", "MIT notice")])
    assert license_scan.scan_licenses(empty_docs(spark)).collect() == []


def test_near_duplicates(spark):
    docs = edge_docs(spark)
    got = minhash_dedup.near_duplicates(docs, k=4).collect()
    assert len(got) == 11
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == near_groups(texts, 4, 80)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got}[4] == 0
    assert minhash_dedup.near_duplicates(empty_docs(spark)).collect() == []


def test_packers(spark):
    docs = edge_docs(spark).repartition(2)
    pieces = window_packing.pack_documents(docs, BPE).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id in (3, 4)) == 2
    starts = [r for r in pieces if r.start == 0]
    assert len(starts) == 11 and {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    rows = token_matrix.pack_matrix(docs, BPE).collect()
    assert sum(s == 0 for r in rows for s in r.doc_starts) == 11
    assert window_packing.pack_documents(empty_docs(spark), BPE).collect() == []
    assert token_matrix.pack_matrix(empty_docs(spark), BPE).collect() == []


def test_pieces(spark):
    docs = edge_docs(spark)
    model = unigram_pieces.shared_model(spark, PIECES)
    encoded = unigram_pieces.encode_pieces(docs, PIECES, model)
    back = unigram_pieces.decode_pieces(encoded, PIECES, model, out_col="back").collect()
    assert len(back) == 11 and all(r.back == (r.text or "") for r in back)
    assert unigram_pieces.encode_pieces(empty_docs(spark), PIECES, model).collect() == []


def test_quality(spark):
    book = quality_ledger.apply_policy(quality_ledger.ledger(edge_docs(spark)), 2).collect()
    by_id = {r.doc_id: r for r in book if r.doc_id is not None}
    assert len(book) == 11 and not any(r.kept for r in book)
    assert by_id[4].n_words == by_id[3].n_words == by_id[5].n_words == 0
    assert (by_id[6].n_words, by_id[6].n_repeat_words) == (40_000, 40_000)
    assert quality_ledger.ledger(empty_docs(spark)).collect() == []


def test_toxicity(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for grammar in (toxicity_grammar.learn_grammar(docs, labels), toxicity_grammar.Grammar(),
                    toxicity_grammar.Grammar({"moron": 5.0}, {"low": 3.0}, [-3.0, 1, 1, 1, 1, 1, 1, 1])):
        got = toxicity_grammar.score_toxicity(docs, grammar).collect()
        assert len(got) == 11 and all(0 <= r.tox_score <= 1 for r in got)
    assert toxicity_grammar.score_toxicity(empty_docs(spark), toxicity_grammar.Grammar()).collect() == []
    assert toxicity_grammar.learn_grammar(empty_docs(spark), labels).logistic == []


def test_secrets(spark):
    docs = edge_docs(spark)
    found = secret_forest.scan_secrets(docs, [], path_col="source").collect()
    assert [(r.doc_id, r.start, len(r.candidate), r.is_secret) for r in found] == [(7, 0, 100_000, False)]
    assert secret_forest.learn_secrets(docs) == []
    clean = secret_forest.redact_secrets(docs, [])
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(
        str(r.text) for r in docs.collect())
    assert secret_forest.scan_secrets(empty_docs(spark), []).collect() == []


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_pipeline_stages(spark, tmp_out, table):
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    docs = (edge_docs(spark) if table == "edge" else empty_docs(spark)).select(
        "doc_id", "text", "lang", "source", "n_chars")
    left = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_out}/{i}")
        docs = spark.read.parquet(f"{tmp_out}/{i}")
        left[name] = docs.count()
    if table == "empty":
        assert set(left.values()) == {0}
        return
    # No label is learned from these ids' tables but the texts are clean: none is toxic. Texts
    # without a letter go; of the equal pair and of the repeated row one stays.
    assert left["toxicity"] == 11 and left["language"] == 7 and left["near_duplicates"] == 5 and left["secrets"] == 5
    assert len(LONG) > 100_000
