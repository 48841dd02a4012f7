"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.llm import (collocations, conversation_trie, decontamination, embedding_dedup, language_id,
                           license_scan, minhash_dedup, quality_ledger, secret_forest, token_matrix,
                           toxicity_grammar, unigram_pieces, window_packing)
from crashlens.llm.common import read_table
from crashlens.llm.oracle_sql import ORACLE_SQL  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def crc_mod(column, n: int):
    return F.crc32(column.cast("string").cast("binary")) % n


def op1_language_id(spark, sf_dir):
    """Network trained on the rows that are not held out, applied to every document."""
    docs = read_table(spark, sf_dir, "documents")
    network = language_id.learn_languages(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = language_id.identify_language(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                        "lang_pred", F.col("lang_score").alias("score"))


def op2_license_digests(spark, sf_dir):
    """Every unit of every document that is a known licence."""
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents: 4-word shingles, similarity 0.8."""
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_token_matrix(spark, sf_dir):
    """All documents as rows of a token matrix, packed best-fit-decreasing."""
    return token_matrix.pack_matrix(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_unigram_pieces(spark, sf_dir):
    """Every whole text encoded and decoded again: ids by count and checksum, and whether the
    text came back."""
    path = tokenizer_path("piece_bpe_32k.model")
    model = unigram_pieces.shared_model(spark, path)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = unigram_pieces.encode_pieces(docs, path, model)
    back = unigram_pieces.decode_pieces(encoded, path, model, out_col="back")
    return back.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
                       F.crc32("piece_ids").alias("ids_crc32"), (F.col("back") == F.col("text")).alias("round_trip"))


def op6_window_packing(spark, sf_dir):
    """Every piece of every document, packed by the window program."""
    pieces = window_packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                           tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op7_quality_ledger(spark, sf_dir):
    """The ledger of all documents under policy 2."""
    book = quality_ledger.apply_policy(quality_ledger.ledger(read_table(spark, sf_dir, "documents")), 2)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failures").bitwiseAND(F.lit(quality_ledger.BASE)) != 0).alias("base_failed"),
                       "kept", "failures")


def op8_toxicity_grammar(spark, sf_dir):
    """Grammar learned from the rows that are not held out, applied to every document."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    grammar = toxicity_grammar.learn_grammar(docs, labels)
    scored = toxicity_grammar.score_toxicity(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
                         F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op9_projection_collisions(spark, sf_dir):
    """Links and groups of all vectors at cosine 0.9."""
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_secret_forest(spark, sf_dir):
    """Every candidate of every document, judged by the forest."""
    return secret_forest.find_and_judge(read_table(spark, sf_dir, "documents"), path_col="source")


def op11_conversation_trie(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt with shared openings."""
    return conversation_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), shared_every=100, shared_most=6)


def op12_suffix_decontamination(spark, sf_dir):
    """Every document against every window of ten words of the benchmark."""
    return decontamination.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark, sf_dir):
    """The first 2,000 collocations of each language of all documents."""
    return collocations.mine_collocations(read_table(spark, sf_dir, "documents"), support=30, top=2000)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_digests": op2_license_digests,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_token_matrix": op4_token_matrix,
    "op5_unigram_pieces": op5_unigram_pieces,
    "op6_window_packing": op6_window_packing,
    "op7_quality_ledger": op7_quality_ledger,
    "op8_toxicity_grammar": op8_toxicity_grammar,
    "op9_projection_collisions": op9_projection_collisions,
    "op10_secret_forest": op10_secret_forest,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_suffix_decontamination": op12_suffix_decontamination,
    "op13_phrase_collocations": op13_phrase_collocations,
}
