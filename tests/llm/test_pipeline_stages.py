"""Stages of the pipeline on planted rows."""

import corpus_pipeline
import numpy as np
from crashlens.llm import language_reject
from tests.conftest import SF_SMALL
from tests.llm import helpers

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))


def test_near_duplicates_with_recurring_ids(spark):
    a, b, c, d = (words(s) for s in range(4))
    near_a = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (2, near_a), (2, b), (3, c), (None, c), (None, d), (None, d), (4, ""), (4, ""), (5, None), (6, b)]
    out = corpus_pipeline.near_duplicates(spark, table(spark, rows), SF_SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, d), (4, ""), (4, ""), (5, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, table(spark, rows).limit(0), SF_SMALL).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    groups = helpers.near_groups({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect())
    assert kept == sorted(i for i in groups if groups[i] == i)


JUNK = ["zxqj vbkq wqzx pqxj kzvw xxqz jqvk bvqz wxkj qqzv " * 5, "这是一个关于语言识别的简短中文文本没有拉丁字母" * 5,
        "Это короткий русский текст о распознавании языка " * 5, "wxk"]


def test_language_rejects_junk_and_unlearned_scripts_only(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    junk = spark.createDataFrame([(900_000 + i, t, None, "s", len(t)) for i, t in enumerate(JUNK)] + [(900_100, None, "en", "s", 0)],
                                 docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(junk), SF_SMALL).select("doc_id").collect()}
    wordy = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert kept == wordy


def test_letter_pairs(spark):
    assert language_reject.pair_codes("").tolist() == language_reject.pair_codes("a").tolist() == []
    codes = language_reject.pair_codes("Ab c-dé")
    assert codes.tolist() == [(97 << 21) | 98, (100 << 21) | 0xE9]
    assert language_reject.known_share("ab dé ab xx", np.sort(codes)) == 0.75
    assert language_reject.known_share("1 2", codes) == 1.0
    known = language_reject.learn_letter_pairs(table(spark, [(1, "ab ab ba"), (2, None), (3, ""), (None, "qq")]))
    assert known.pairs.tolist() == sorted({(97 << 21) | 98, (98 << 21) | 97}) and known.floor == 0.5
    assert language_reject.learn_letter_pairs(table(spark, [(1, "a b")])) is None
    assert language_reject.learn_letter_pairs(table(spark, [(1, "x")]).limit(0)) is None
