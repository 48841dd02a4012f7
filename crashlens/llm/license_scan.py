"""License scan (operator 2): canonical digests of whole texts, hash-joined to known ones.

A text is brought to a canonical form: lower case, lines that name a copyright holder and list
marks left out, equivalent spellings made one, every run of other than letters and digits
(comment marks too) one blank. Its digest, and that of each of its paragraphs and lines (and of
as many neighbouring paragraphs as a known licence has), is then looked up among the digests of
the known licences' canonical texts. A match means that the whole unit is the licence.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm.license_texts import KNOWN_LICENSES

#: Spellings that licence texts use alike, lower case, in this order.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"),
             ("https://", "http://"), ("noninfringement", "non-infringement"), ("whilst", "while"),
             ("favour", "favor"), ("organisation", "organization"), ("’", "'"))

#: Whatever a comment or list puts before a line's first word.
_MARKS = r"(?md)^[^\p{L}\p{N}\n©(]*"
#: A line that names a holder: "copyright" with a sign, a year or "by" after it, or a sign with
#: "copyright" or a year. Licence prose that a line break puts at "copyright notice" is none.
#: "All rights reserved" on the line below goes with it.
HOLDER_LINE = (_MARKS + r"(?:(?:portions[ \t]+)?copyright[ \t,:]*(?:\(c\)|©|by[ \t]|[<\[{]?(?:year|yyyy)|[12][0-9]{3})"
               r"|©|\(c\)[ \t]*(?:copyright|[12][0-9]{3}))[^\n]*(?:\n|\z)"
               r"(?:[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*(?:\n|\z))?")
#: Numbers and letters of list items; bullets go with all other signs.
LIST_MARK = r"(?md)^[^\p{L}\p{N}\n]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\))[ \t]+"
#: Distinct first words of known licences that are kept on the driver.
MAX_FIRST_WORDS = 10_000


def canonical(text):
    """Canonical form of a text column; line breaks stay."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, "\r\n?", "\n")), HOLDER_LINE, "")
    out = F.regexp_replace(out, LIST_MARK, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def flat(text):
    """A canonical text on one line."""
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def paragraphs(text):
    return F.filter(F.transform(F.split(text, r"\n *\n"), flat), lambda p: p != "")


def known_digests(spark: SparkSession, known: dict[str, str] | DataFrame = KNOWN_LICENSES) -> DataFrame:
    """``license, digest, n_paragraphs, first_word`` of the known texts: a dict by name, or a
    table ``license, text`` (null and blank texts are left out; licences of one canonical text
    share its digest)."""
    if not isinstance(known, DataFrame):
        entries = [F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in sorted(known.items())]
        known = spark.range(1).select(F.explode(F.array(*entries)).alias("k")).select("k.*")
    rows = known.select("license", canonical(F.col("text")).alias("t")).select(
        "license", flat(F.col("t")).alias("whole"), F.size(paragraphs(F.col("t"))).alias("n_paragraphs"))
    return rows.where("whole <> ''").select("license", F.md5("whole").alias("digest"), "n_paragraphs",
                                            first_word(F.col("whole")).alias("first_word")).distinct()


def first_word(text):
    return F.substring_index(text, " ", 1)


def scan_licenses(docs: DataFrame, known: dict[str, str] | DataFrame = KNOWN_LICENSES, text_col: str = "text",
                  id_col: str = "doc_id") -> DataFrame:
    """One row per match: ``doc_id, unit, unit_no, license, digest``.

    ``unit`` is ``text`` (the whole document), ``paragraphs`` (a run of neighbouring
    paragraphs; ``unit_no`` is its first, from 0) or ``line``. Blank units match nothing, so
    null and empty texts have no row; repeated rows give repeated matches; null ids stay null;
    an empty table gives no row; other columns are not read. Licences of one canonical text
    (ties) give a row each. Very long texts are read whole. A holder's line goes with all that
    stands on it, so a licence that follows its holder on one line is not found.

    Only units that begin with a known licence's first word are digested, which loses none.
    These words and the paragraph counts are the only thing the driver reads from ``known``, at
    most ``MAX_FIRST_WORDS`` rows (more are an error). The join strategy is left to Spark's
    size check.
    """
    digests = known_digests(docs.sparkSession, known)
    heads = digests.select("n_paragraphs", "first_word").distinct().limit(MAX_FIRST_WORDS + 1).collect()
    if len(heads) > MAX_FIRST_WORDS:
        raise ValueError(f"the known licences begin in more than {MAX_FIRST_WORDS} ways")
    counts = sorted({1, *(n for n, _ in heads)})
    words = sorted({w for _, w in heads})
    step = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("t"))
    step = step.select("doc_id", flat(F.col("t")).alias("whole"), paragraphs(F.col("t")).alias("p"),
                       F.transform(F.split("t", "\n"), lambda x: F.trim(x)).alias("l"))

    def unit(kind, no, text):
        return F.struct(F.lit(kind).alias("unit"), no.cast("int").alias("unit_no"), F.md5(text).alias("digest"))

    def may_begin(text):
        return first_word(text).isin(words)

    def runs_of(n):
        return F.transform("p", lambda x, i: F.when(
            (i + n <= F.size("p")) & may_begin(x),
            unit("paragraphs", i, F.array_join(F.slice("p", i + 1, F.lit(n)), " "))))

    units = F.concat(F.array(F.when(may_begin(F.col("whole")), unit("text", F.lit(0), F.col("whole")))),
                     *map(runs_of, counts), F.transform("l", lambda x, i: F.when(may_begin(x), unit("line", i, x))))
    rows = step.select("doc_id", F.explode(F.filter(units, lambda u: u.isNotNull())).alias("u")).select("doc_id", "u.*")
    return rows.join(digests.select("digest", "license"), "digest").select(
        "doc_id", "unit", "unit_no", "license", "digest")
