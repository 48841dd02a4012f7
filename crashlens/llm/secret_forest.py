"""Secret scan (operator 10): candidates, then a random forest that removes false positives.

Every run of ``MIN_LENGTH`` or more characters that keys are made of is a candidate; '=' ends a run
(only padding stays), so the name in ``KEY=value`` is text before it, and segments joined by
single dots are one run. What a key word is given with an assignment sign, and the password in
``//user:password@host``, is a candidate from ``MIN_GIVEN`` characters on, whatever it is made of. Its length,
character transitions, dictionary coverage, path-like surroundings and neighbouring words
become small whole numbers (bins). The forest is grown level by level: one grouped aggregate
gives the label counts of all trees, nodes, features and bins, the driver picks each node's
split, and the next level's rows follow by an expression. The grown trees are nested
conditions, so scoring is a projection. DataFrame functions only.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crashlens.llm.common import Staging

MIN_LENGTH, MIN_GIVEN = 16, 6
# Possessive throughout: no backtracking and no recursion on long texts. Group 1 is what a match
# begins with, group 2 the candidate; it has an unbroken run of that length (as no host name has).
CANDIDATE = (r"()((?=[A-Za-z0-9+/=_.-]{%d})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+(?:=++(?![A-Za-z0-9+/_-]))?)"
             % MIN_LENGTH)
UNBROKEN = r"[A-Za-z0-9+/=_-]{%d}" % MIN_LENGTH
CONTEXT = 40

# Word pieces of ordinary text, words beside secrets, words beside harmless keys.
DICTIONARY = ("the", "and", "ing", "tion", "that", "with", "ment", "ness", "able", "ent", "est", "ers", "for", "her",
              "str", "eau", "que", "elle", "aux", "oir", "les", "des", "sch", "ung", "heit", "keit", "lich", "ein",
              "ver", "gen", "ber", "ado", "ara", "ión", "cion", "mente", "dad", "los", "las", "test", "example",
              "name", "user", "file", "data", "type", "value", "http", "www", "com", "org", "html")
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth",
             "credential", "private", "bearer", "private key", "privatekey", "secretkey", "accesskey", "_key", "-key",
             "_pass", "passphrase")
HARMLESS_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "revision", "example",
                  "integrity", "phone", "card")


def alternatives(words) -> str:
    return "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


# Formats that settle a finding by itself: keys of known issuers, and what is no key.
KEY_FORMATS = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}"
               r"|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}"
               r"|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
               r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)$")
HARMLESS_FORMATS = (r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9._-]*Z?"
                    r"|[/._+-]*+(?:(?:[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,})[0-9]{0,3}[/._+-]++)++"
                    r"(?:[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,})?[0-9]{0,3})$")
#: Call and index expressions, variables and placeholders: code that names a secret, not one.
CODE = (r"^(?:[$%]?[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|->|::)[A-Za-z_][A-Za-z0-9_]*)*[(\[].*|\$[{(]?[A-Za-z_].*|\{\{?.*\}|<.*>|%[a-z(].*"
        r"|[A-Za-z_]+\|?[A-Za-z_]*[)\]}>;:,]*)$")
PEM_HEAD = r"PRIVATE KEY-----\s*$"
PEM_BODY = r"(PRIVATE KEY-----\s*+)((?s:(?:(?!\s{0,4}+-----).){%d,}+)(?=\s{0,4}+-----END))" % MIN_LENGTH
# A value behind a key word (the end of a name) and a sign: in quotes, or up to a blank or separator.
# The sign comes first and the key word is looked for behind it: signs are rare, words are not.
GIVEN = (r"([=:](?<=(?i:%s)[\"'`\])]{0,2}[ \t]{0,8}[=:])(?!//)[=>]?[ \t]{0,8}[\"'`]?)"
         r"((?<=\")[^\"\r\n]{%d,}+(?=\")|(?<=')[^'\r\n]{%d,}+(?=')|(?<=`)[^`\r\n]{%d,}+(?=`)"
         r"|(?:[^\s\"'`<>&,;]|&(?![A-Za-z0-9_.-]{1,64}=)|[,;](?!\s|$)){%d,}+)"
         % ((alternatives(KEY_WORDS).replace("(", "(?:"),) + (MIN_GIVEN,) * 4))
USER = r"(?:://[^\s/:@\"'`]*|^[^\s/:@\"'`]{%d}):$" % (CONTEXT - 1)
URL_PASSWORD = r"(://[^\s/:@\"'`]*+:)([^\s/@\"'`]{%d,}+(?=@))" % MIN_GIVEN
#: What candidates are found by, each with what its candidates must contain.
FORMS = ((CANDIDATE, UNBROKEN), (PEM_BODY, ""), (GIVEN, ""), (URL_PASSWORD, ""))

FEATURES = ("length", "transitions", "digits", "capitals", "variety", "dictionary", "vowels", "path_like", "doc_path",
            "key_word", "assigned", "quoted", "harmless_word")
#: Flags that labels follow from. Some trees do not see them, and every positive finding is also
#: learned without them, as it would look in plain text.
DECIDING = ("key_word", "assigned", "quoted", "harmless_word")
BINS = 16

PER_LABEL = 4000
TREES, DEPTH, TRIED, LEAST_ROWS = 10, 4, 5, 4


def find_candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    path_col: str | None = None) -> DataFrame:
    """Every candidate of every whole text: ``doc_id, start, candidate, before, after, path``.

    ``start`` counts characters from 0. ``path`` is ``path_col`` (a file path, null without it).
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), path.alias("path"))
    rows = rows.withColumns({f"has{n}": F.col("t").rlike(p) for n, (p, _) in enumerate(FORMS)})
    rows = rows.where(" or ".join(f"has{n}" for n in range(len(FORMS)))).withColumn("row", F.monotonically_increasing_id())
    # Matches of each form, and the text between them, as columns of their own: evaluated once, and
    # only for texts that have the form. The first form's matches are its candidates.
    parts = []
    for n, (p, _) in enumerate(FORMS):
        for group, name in enumerate(("m", "lead", "c") if n else ("m",)):
            parts += [F.when(F.col(f"has{n}"), F.regexp_extract_all("t", F.lit(p), F.lit(group))).alias(f"{name}{n}")]
        parts += [F.when(F.col(f"has{n}"), F.split("t", p, -1)).alias(f"gap{n}")]
    rows = rows.select("doc_id", "path", "row", *parts)

    def tail(col: str, i):
        """The end of an element; nothing for the one before the first."""
        return F.coalesce(F.when(i >= 0, F.right(F.get(col, i), F.lit(CONTEXT))), F.lit(""))

    def lead(n: int, i) -> Column:
        return F.get(f"lead{n}", i) if n else F.lit("")

    def matches(n: int, holds: str) -> Column:
        # The match before belongs to the context too: it may be the name that the candidate is given to.
        m, gap = f"m{n}", f"gap{n}"
        return F.coalesce(F.transform(f"c{n}" if n else m, lambda c, i: F.struct(
            F.lit(n).alias("form"), i.alias("pos"), c.alias("candidate"), c.rlike(holds).alias("whole"),
            F.char_length(F.get(gap, i)).alias("skip"), F.char_length(lead(n, i)).alias("into"),
            F.char_length(F.get(m, i)).alias("long"),
            F.right(F.concat(tail(gap, i - 1), tail(m, i - 1), tail(gap, i), lead(n, i)), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gap, i + 1), F.lit(CONTEXT)).alias("after"))), F.array())

    rows = rows.select("doc_id", "path", "row", F.explode(F.concat(*[
        matches(n, holds) for n, (_, holds) in enumerate(FORMS)])).alias("f")).select("doc_id", "path", "row", "f.*")
    # One exchange serves both windows. What several forms find at one place is one candidate.
    upto = Window.partitionBy("row", "form").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("row").withColumn("start", (
        F.sum(F.col("skip") + F.col("long")).over(upto) - F.col("long") + F.col("into")).cast("long")).where("whole")
    same = Window.partitionBy("row", "start", "candidate").orderBy("form")
    return rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").select(
        "doc_id", "start", "candidate", "before", "after", "path")


def features(found: DataFrame) -> DataFrame:
    """``found`` with one whole number from 0 to ``BINS - 1`` per feature."""
    c, size = F.col("candidate"), F.char_length("candidate")
    low = F.lower(c)

    def share(part: Column) -> Column:
        """``part`` of the candidate's length, in 15 steps."""
        return F.least(F.lit(BINS - 1), F.floor(15 * part / size)).cast("int")

    def left_by(col: Column, pattern: str) -> Column:
        return size - F.char_length(F.regexp_replace(col, pattern, ""))

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("int")

    before, after = F.lower("before"), F.lower("after")
    # A transition: a neighbouring pair of different kinds among lower, upper, digit, other.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^a-zA-Z0]+", "-")
    beside = F.concat(F.right(before, F.lit(1)), F.left(after, F.lit(1)))
    return found.withColumns({
        "length": F.least(F.lit(BINS - 1), F.floor(size / 4)).cast("int"),
        "transitions": share(F.char_length(kinds) - 1),
        "digits": share(left_by(c, "[0-9]+")),
        "capitals": share(left_by(c, "[A-Z]+")),
        "variety": share(F.size(F.array_distinct(F.split(c, "")))),
        "dictionary": share(left_by(low, alternatives(DICTIONARY))),
        "vowels": share(left_by(low, "[aeiou]+")),
        "path_like": flag(c.contains("/")) + flag(beside.rlike(r"[/\\.@]")),
        "doc_path": flag(F.lower("path").rlike("test|example|fixture|sample|doc")),
        "key_word": flag(before.rlike(alternatives(KEY_WORDS) + r"[^a-z0-9]{0,8}$") | before.rlike(USER)),
        "assigned": flag(before.rlike(r"(=|:|:=|=>)[\s\"'`]*$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "harmless_word": flag(F.concat(before, F.lit(" "), after).rlike(alternatives(HARMLESS_WORDS))),
    })


def is_known_key() -> Column:
    """Whether a finding is a secret by its format alone."""
    return F.col("candidate").rlike(KEY_FORMATS) | F.col("before").rlike(PEM_HEAD)


def is_ordinary() -> Column:
    """Whether a finding is no secret by its form alone: letters only, digits only, words, a UUID,
    a date, or an expression of code; unless its format is that of a known key."""
    c = F.col("candidate")
    return ~is_known_key() & (~c.rlike("[0-9]") | ~c.rlike("[A-Za-z]") | c.rlike(HARMLESS_FORMATS) | c.rlike(CODE))


def label_findings(found: DataFrame) -> DataFrame:
    """The distinct findings that are settled: ``candidate`` (a digest), the features, ``label``.

    The evidence is that of the value, not of the place: 1 if the value has the format of a known
    issuer's key, or a key word is assigned it anywhere and it is nothing ordinary; 0 if it is
    ordinary (letters or digits only, words, a UUID, a date, code), whatever it is assigned to, or
    stands beside a harmless word and no key word is assigned it. Positive findings are returned
    once more without the flags in ``DECIDING``. The others are not returned.
    """
    given = (F.col("key_word") == 1) & (F.col("assigned") == 1)
    f = features(found).select(
        F.md5(F.col("candidate").cast("binary")).alias("candidate"), *FEATURES,
        (is_known_key() | (given & ~is_ordinary())).alias("strong"),
        (is_ordinary() | ((F.col("harmless_word") == 1) & ~given)).alias("harmless"))
    # Distinct first: a value has few different surroundings, so no value is too large for a task.
    f = f.distinct().withColumn("strong", F.max("strong").over(Window.partitionBy("candidate")))
    f = f.withColumn("label", F.when(F.col("strong"), 1).when(F.col("harmless"), 0)).where("label is not null")
    f = f.withColumn("bare", F.explode(F.when(F.col("label") == 1, F.array(F.lit(False), F.lit(True)))
                                       .otherwise(F.array(F.lit(False)))))
    return f.select("candidate", *[F.when(F.col("bare"), 0).otherwise(F.col(c)).alias(c) if c in DECIDING else c
                                   for c in FEATURES], "label")


@dataclass
class Node:
    """A split (``feature`` <= ``at`` goes left) or, without a feature, a leaf."""

    share: float
    feature: str | None = None
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def as_condition(node: Node, value) -> Column:
    """The tree as nested conditions; ``value(leaf)`` is what a leaf yields."""
    if node.feature is None:
        return value(node)
    return F.when(F.col(node.feature) <= node.at, as_condition(node.left, value)).otherwise(
        as_condition(node.right, value))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.feature is None else _leaves(node.left) + _leaves(node.right)


def _gini(n: float, pos: float) -> float:
    return 0.0 if n <= 0 else 2.0 * pos * (n - pos) / n


def _best_split(counts: dict[tuple[str, int], tuple[float, float]], tried: list[str]):
    """(gain, feature, bin, left counts, right counts) of the best split, or None."""
    best = None
    for f in tried:
        rows = sorted((b, c) for (g, b), c in counts.items() if g == f)
        n, pos = sum(c[0] for _, c in rows), sum(c[1] for _, c in rows)
        ln = lp = 0.0
        for b, c in rows[:-1]:
            ln, lp = ln + c[0], lp + c[1]
            if min(ln, n - ln) < LEAST_ROWS:
                continue
            gain = _gini(n, pos) - _gini(ln, lp) - _gini(n - ln, pos - lp)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, b, (ln, lp), (n - ln, pos - lp))
    return best


def train_forest(labelled: DataFrame, per_label: int = PER_LABEL, trees: int = TREES, depth: int = DEPTH,
                 seed: int = 10) -> list[Node]:
    """A forest from ``labelled`` findings (feature columns, ``candidate``, ``label``).

    At most about ``per_label`` findings of either label are used, those with the lowest hash;
    copies of a finding count once. Without findings of both labels there is no forest.
    """
    staging = Staging(labelled.sparkSession, "forest")
    h = F.xxhash64("candidate", *FEATURES)
    rows = staging.write(labelled.select("label", *FEATURES, h.alias("h")).distinct(), "labelled")
    totals = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if set(totals) != {0, 1}:
        return []
    scale = 1 << 30
    share = F.when(F.col("label") == 1, F.lit(int(min(1.0, per_label / totals[1]) * scale))).otherwise(
        F.lit(int(min(1.0, per_label / totals[0]) * scale)))
    # Bootstrap: each tree sees a row 0, 1 or 2 times, by a hash.
    sample = staging.write(
        rows.where(F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(scale)) < share)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("weight", F.pmod(F.xxhash64("h", "tree", F.lit(seed)), F.lit(3))).where("weight > 0"), "sample")
    draw = random.Random(seed)
    forest = [Node(0.5) for _ in range(trees)]
    shape = [f for f in FEATURES if f not in DECIDING]
    open_nodes = {t: [forest[t]] for t in range(trees)}
    for _ in range(depth):
        # Which open node a row of a tree has reached; null: a closed one.
        numbers = {t: {id(n): i for i, n in enumerate(nodes)} for t, nodes in open_nodes.items() if nodes}
        if not numbers:
            break
        place = F.lit(None).cast("int")
        for t in numbers:
            place = F.when(F.col("tree") == t, as_condition(
                forest[t], lambda leaf, t=t: F.lit(numbers[t].get(id(leaf))).cast("int"))).otherwise(place)
        stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
        counts: dict = {}
        for r in (sample.withColumn("node", place).where("node is not null").withColumn("x", stacked)
                  .groupBy("tree", "node", "x.feature", "x.bin")
                  .agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("pos")).collect()):
            counts.setdefault((r[0], r[1]), {})[r[2], r[3]] = (float(r[4]), float(r[5]))
        after: dict[int, list[Node]] = {t: [] for t in range(trees)}
        for t, nodes in open_nodes.items():
            for i, node in enumerate(nodes):
                here = counts.get((t, i), {})
                n = sum(c[0] for (f, _), c in here.items() if f == FEATURES[0])
                pos = sum(c[1] for (f, _), c in here.items() if f == FEATURES[0])
                if n:
                    node.share = (pos + 0.5) / (n + 1)
                split = _best_split(here, draw.sample(FEATURES if t % 3 else shape, TRIED))
                if split is None:
                    continue
                _, node.feature, node.at, (ln, lp), (rn, rp) = split
                node.left, node.right = Node((lp + 0.5) / (ln + 1)), Node((rp + 0.5) / (rn + 1))
                after[t] += [node.left, node.right]
        open_nodes = after
    return forest


def score_findings(found: DataFrame, forest: list[Node]) -> DataFrame:
    """``found`` with ``probability`` (mean leaf share; 1 for a known key format, 0 for ordinary
    values) and ``is_secret`` (0.5 or more). Without a forest only settled findings count: known
    formats, and values that are nothing ordinary and that a key word is assigned."""
    keep = [c for c in found.columns if c not in ("probability", "is_secret")]
    if forest:
        total = F.lit(0.0)
        for tree in forest:
            total = total + as_condition(tree, lambda leaf: F.lit(float(leaf.share)))
        judged = F.round(total / len(forest), 6)
    else:
        judged = F.when((F.col("key_word") == 1) & (F.col("assigned") == 1), 1.0).otherwise(0.0)
    scored = features(found.select(*keep)).withColumn(
        "probability", F.when(is_known_key(), F.lit(1.0)).when(is_ordinary(), F.lit(0.0)).otherwise(judged))
    return scored.select(*keep, "probability").withColumn("is_secret", F.col("probability") >= 0.5)


def learn_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = None,
                  per_label: int = PER_LABEL) -> list[Node]:
    """A forest from the documents' own settled findings (see ``label_findings``)."""
    return train_forest(label_findings(find_candidates(docs, text_col, id_col, path_col)), per_label)


def scan_secrets(docs: DataFrame, forest: list[Node], text_col: str = "text", id_col: str = "doc_id",
                 path_col: str | None = None) -> DataFrame:
    """One row per candidate: ``doc_id, start, candidate, before, after, path, probability,
    is_secret``. Null and empty texts have none; repeated rows give their findings again; null
    ids stay null; other columns are not read; an empty table gives an empty result."""
    return score_findings(find_candidates(docs, text_col, id_col, path_col), forest)


def find_and_judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = None,
                   per_label: int = PER_LABEL) -> DataFrame:
    """:func:`scan_secrets` with a forest learned from the same documents. The texts are read
    once: candidates are written, learned from and judged."""
    found = Staging(docs.sparkSession, "candidates").write(find_candidates(docs, text_col, id_col, path_col), "candidates")
    return score_findings(found, train_forest(label_findings(found), per_label))


def redact_secrets(docs: DataFrame, forest: list[Node] | None = None, text_col: str = "text", path_col: str | None = None,
                   mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; all rows stay, and texts
    without a secret stay as they are, byte for byte.

    A secret is replaced where it was found; overlapping findings become one mark. Other places of
    the same value in the text are replaced only if it has ``MIN_LENGTH`` characters or more and is
    nothing ordinary. Without ``forest`` one is learned from the same documents
    (:func:`find_and_judge`); an empty one leaves the settled findings. Secrets are gathered by
    the text's digest (copies of a text have the same), so a text's list is bounded by the text
    itself, and joined back to the rows.
    """
    key = "__text_key"
    keyed = docs.withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256))
    columns = [F.col(key).alias("k"), F.col(text_col).alias("t")] + ([F.col(path_col).alias("p")] if path_col else [])
    args = (keyed.select(*columns), "t", "k", "p" if path_col else None)
    judged = find_and_judge(*args) if forest is None else scan_secrets(args[0], forest, *args[1:])
    found = judged.where("is_secret").select("doc_id", F.col("start").cast("int").alias("start"), "candidate",
                                             (F.col("start") + F.char_length("candidate")).cast("int").alias("end")).distinct()
    # Findings that overlap: one stretch.
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", F.coalesce(F.col("start") >= far, F.lit(True)).cast("int"))
    apart = apart.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (apart.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
             .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans")))
    again = F.when((F.char_length("candidate") >= MIN_LENGTH) & (F.col("candidate").rlike("[0-9]")) & (F.col("candidate").rlike("[A-Za-z]")),
                   F.struct(F.char_length("candidate").alias("n"), "candidate"))
    # Longest first: a secret inside a longer one must not break it up.
    values = found.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set(again))).alias("__values"))
    lists = spans.join(values, "doc_id").withColumnRenamed("doc_id", key)
    whole = F.col(text_col).cast("string")

    def before(i):
        """Where the text between the spans before ``i`` and ``i`` begins."""
        return F.when(i == 0, 0).otherwise(F.get(F.col("__spans"), i - 1)["end"])

    parts = F.transform("__spans", lambda s, i: F.concat(F.substring(whole, before(i) + 1, s["start"] - before(i)), F.lit(mark)))
    rest = F.substring(whole, F.get(F.col("__spans"), F.size("__spans") - 1)["end"] + 1, F.char_length(whole))
    text = F.aggregate(F.col("__values.candidate"), F.concat(F.array_join(parts, ""), rest), lambda t, s: F.replace(t, s, F.lit(mark)))
    return (keyed.join(lists, key, "left").withColumn(text_col, F.when(F.col("__spans").isNotNull(), text).otherwise(whole))
            .drop(key, "__spans", "__values"))
