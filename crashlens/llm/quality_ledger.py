"""Quality rules as a bitmask ledger (operator 7).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure
bit per rule; a policy is a versioned set of bits, so policies are applied, compared and
ablated by bitwise operations on the ledger without reading a text again. DataFrame functions
only: no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rule -> SQL condition (true: the document fails) over the measurements. The position in
#: this table is the rule's bit. Ratios are compared in whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "capitals": "100 * n_upper > 40 * word_chars",
    "exclamations": "10 * n_exclamations > 3 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Version -> mask. Version 1 is the base rules alone.
POLICIES: dict[int, int] = {1: BASE, 2: sum(BIT.values())}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_exclamations")


def count_of(text, chars: str):
    """How many characters of ``text`` are in ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and the measurements of each row's whole text.

    Words are runs of other than ASCII blanks; null texts have none. A 3-word window counts
    as repeated if the text has it twice or more; windows are compared by a 64-bit hash, in one
    sort per text, so the work per text is O(n log n).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    step = step.select(
        "doc_id",
        F.filter(F.split("t", BLANKS), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "").alias("l"),
        F.char_length(F.translate("t", BLANK_CHARS, "")).cast("long").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        count_of(F.col("t"), "!").alias("n_exclamations"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"))
    step = step.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_lines": F.size("l").cast("long"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        "h": F.transform("w", lambda w: F.xxhash64(w))}).drop("w", "l")
    step = step.withColumn("s", F.expr(
        "if(n_words < 3, cast(array() as array<struct<h:bigint,i:int>>), array_sort(transform("
        "sequence(0, cast(n_words as int) - 3), i -> struct(xxhash64(h[i], h[i + 1], h[i + 2]) as h, i as i))))"))
    # Places of windows that have an equal neighbour in the sorted order.
    step = step.drop("h").withColumn("p", F.expr(
        "array_sort(filter(transform(s, (x, j) -> if(x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h, x.i, -1)),"
        " i -> i >= 0))")).drop("s")
    # A window covers three words, less those that the window before it covers already.
    step = step.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(p, (i, j) -> least(3, i - coalesce(get(p, j - 1), -3))), 0L, (a, x) -> a + x)"))
    return step.select("doc_id", *MEASURES)


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           rules: Mapping[str, str] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measurements and ``failures`` (long).

    Null and empty texts measure 0 everywhere and fail ``few_words``; repeated rows and null
    ids stay as they are; other columns are not read; an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(rules.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs, text_col, id_col).withColumn("failures", failures.cast("long"))


def apply_policy(book: DataFrame, version: int, policies: Mapping[int, int] = POLICIES) -> DataFrame:
    """The ledger with ``kept``: no failure among the policy's bits."""
    return book.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policies[version])) == 0)


def ablations(book: DataFrame, policies: Mapping[int, int] = POLICIES,
              rules: Mapping[str, str] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, and documents that
    only this rule rejects (they would be kept without it). One aggregation of the ledger by
    failure mask, at most 2 ** rules rows, then bitwise tests on those."""
    masks = book.groupBy("failures").agg(F.count("*").alias("n"))
    per = [F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"),
                    F.lit(mask).cast("long").alias("mask"))
           for v, mask in policies.items() for i, name in enumerate(rules) if mask >> i & 1]
    rows = masks.withColumn("p", F.explode(F.array(*per))).select("failures", "n", "p.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    return rows.groupBy("version", "rule").agg(
        F.coalesce(F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))
