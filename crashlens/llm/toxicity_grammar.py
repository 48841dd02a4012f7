"""Toxicity (operator 8): a weighted finite-state grammar over clauses.

Five transducers read the words of a clause. Each is plain data: its states, where a class of
word or any other word takes it, and how each state rewrites the events on the tape.

* *insult* turns a learned word or word beginning into a plain insult;
* *threat* writes a threat where a verb of harm and a target stand within ``REACH`` words;
* *target* turns a plain insult into a targeted one once somebody is addressed;
* *negation* turns what stands within ``SCOPE`` words after a negation into a negated insult,
  and drops a threat there;
* *reported speech* does so for what follows a verb of saying.

A contrasting conjunction ends negation and report, the clause's end resets all. ``compose``
builds their cascade, each reading what the one before it wrote, as one automaton over the
reachable product states. An insult emits its entry's weight on the channel that its event
ends as, a threat the weight of its verb. A document's channels, summed over its clauses, go
through a logistic function fitted on labelled rows.

Learning takes two Spark passes over a sample of labelled documents, at most ``max_positive``
and ``max_negative`` of them, chosen by a hash of the id and dealt into two halves. Word counts
by label and half give the entries of either half and of both; then each half's channels are
read with the other half's entries (so that no text meets entries learned from it), and the
logistic weights are fitted on them all. Verb weights are log ratios of the labels too, drawn
towards ``THREAT_WEIGHT`` where a verb is rare.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import batch_of, python_tasks, texts

# Closed-class words of the four languages.
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "tu", "te", "toi", "vous", "il",
           "elle", "ils", "lui", "du", "dich", "euch", "ihr", "ihn", "ihnen", "sie", "er", "tú", "usted",
           "ustedes", "él", "ella"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "don't", "won't", "ne", "pas", "jamais", "nicht",
             "nie", "kein", "keine", "nunca", "jamás"}
REPORTS = {"said", "says", "wrote", "quoted", "called", "dit", "écrit", "sagte", "schrieb",
           "dijo", "escribió"}
CONTRASTS = {"but", "mais", "aber", "sondern", "pero", "sino"}
# Verbs of harm as stems, and the endings that their forms take.
THREAT_STEMS = {
    "en": "kill hurt destroy beat burn stab shoot attack",
    "fr": "tu frapp",
    "fr_ire": "détrui",
    "de": "töt schlag schläg zerstör",
    "es": "mat golpe",
    "es_ir": "destru",
}
THREAT_ENDINGS = {
    "en": ", s, ed, ing, en, bed, bing",
    "fr": "e, es, ent, er, ez, ons, é, ée, és, ées, ait, aient, era, erai, eras, eront",
    "fr_ire": "s, t, re, sent, ra, rai, ras, ront, te",
    "de": "e, est, et, t, st, en, te, ten, ete, eten",
    "es": "o, as, a, an, ar, aré, arás, ará, arán, ó, é, ado, ada, ando, aron",
    "es_ir": "ir, yo, yes, ye, yen, yó, ido, ida",
}
THREAT_IRREGULAR = {"shot": "shoot", "schlug": "schlag", "schlugen": "schlag", "geschlagen": "schlag",
                    "getötet": "töt"}
THREAT_WEIGHT = 3.0
THREAT_PRIOR = 5.0  # documents that THREAT_WEIGHT counts for
REACH, SCOPE = 4, 4


def threat_forms() -> dict[str, str]:
    """The forms of the verbs of harm, each with its stem."""
    forms = {stem + ending.strip(): stem for kind, stems in THREAT_STEMS.items() for stem in stems.split()
             for ending in THREAT_ENDINGS[kind].split(",")}
    return {**forms, **THREAT_IRREGULAR}


THREATS = threat_forms()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = ".!?;:\n"
CLAUSE_CUT = re.compile(r"[.!?;:\n]")
SHORTEST, LONGEST = 3, 8  # lengths of word beginnings that are counted
CHANNELS = ("plain", "targeted", "negated", "reported", "threat", "hits", "density")

MAX_POSITIVE = 4000
MAX_NEGATIVE = 8000
MIN_SUPPORT = 3
MIN_WEIGHT = 2.0


@dataclass(frozen=True)
class Transducer:
    """``moves``: (state, word class) -> state. ``lapses``: state -> state on a word without a
    move. ``writes``: (state after the word, event) -> event, or None to drop it; other events
    pass. What neither names stays as it is."""

    start: str
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    lapses: dict[str, str] = field(default_factory=dict)
    writes: dict[tuple[str, str], str | None] = field(default_factory=dict)

    def read(self, state: str, symbol: str, events: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        """One word, by its classes (the letters of ``symbol``), with the events on the tape."""
        after, moved = state, False
        for letter in symbol:
            if (after, letter) in self.moves:
                after, moved = self.moves[after, letter], True
        if not moved:
            after = self.lapses.get(state, state)
        written = (self.writes.get((after, e), e) for e in events)
        return after, tuple(e for e in written if e)


#: Classes of words: contrast, negation, report, threat verb, target, insult.
LETTERS = "CNRTYI"


def countdown(name: str, length: int) -> list[str]:
    """States ``name`` + length ... ``name`` + 1, each lapsing into the next."""
    return [f"{name}{k}" for k in range(length, 0, -1)]


def transducers() -> list[Transducer]:
    """Insult, threat, target, negation and reported speech, in the order of the cascade."""
    insult = Transducer("any", writes={("any", "entry"): "plain"})

    verb, aim = countdown("verb", REACH), countdown("aim", REACH)
    threat = Transducer(
        "idle",
        moves={**{(s, "T"): verb[0] for s in ("idle", "hit", *verb)}, **{(s, "Y"): aim[0] for s in ("idle", "hit", *aim)},
               **{(s, "Y"): "hit" for s in verb}, **{(s, "T"): "hit" for s in aim}},
        lapses={"hit": "idle", **dict(zip(verb, [*verb[1:], "idle"])), **dict(zip(aim, [*aim[1:], "idle"]))},
        writes={("hit", "word"): "threat"})

    target = Transducer("nobody", moves={("nobody", "Y"): "somebody"}, writes={("somebody", "plain"): "targeted"})

    scope = countdown("no", SCOPE + 1)  # the negation itself is the first word
    negation = Transducer(
        "free",
        moves={**{(s, "N"): scope[0] for s in ("free", *scope)}, **{(s, "C"): "free" for s in scope}},
        lapses=dict(zip(scope, [*scope[1:], "free"])),
        writes={(s, e): to for s in scope for e, to in (("plain", "negated"), ("targeted", "negated"), ("threat", None))})

    report = Transducer(
        "own", moves={("own", "R"): "said", ("said", "C"): "own"},
        writes={("said", e): to for e, to in (("plain", "reported"), ("targeted", "reported"),
                                              ("negated", "reported"), ("threat", None))})
    return [insult, threat, target, negation, report]


def run_cascade(machines: list[Transducer], states: tuple[str, ...], symbol: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """One word through all machines: their states after it, and the events that come out."""
    events: tuple[str, ...] = ("word", "entry") if "I" in symbol else ("word",)
    after = []
    for machine, state in zip(machines, states):
        state, events = machine.read(state, symbol, events)
        after.append(state)
    return tuple(after), tuple(e for e in events if e != "word")


def compose(machines: list[Transducer] | None = None) -> dict[tuple[int, str], tuple[int, tuple[str, ...]]]:
    """The composed automaton: (state, symbol) -> (state, events), over the product states that
    can be reached from the start, which is state 0. A symbol is a subset of ``LETTERS``."""
    machines = machines or transducers()
    symbols = ["".join(c for i, c in enumerate(LETTERS) if bits >> i & 1) for bits in range(1 << len(LETTERS))]
    start = tuple(m.start for m in machines)
    number, todo = {start: 0}, [start]
    table: dict[tuple[int, str], tuple[int, tuple[str, ...]]] = {}
    for states in todo:  # grows while it is read
        for symbol in symbols:
            after, events = run_cascade(machines, states, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            table[number[states], symbol] = number[after], events
    return table


@dataclass
class Grammar:
    """``words`` and ``beginnings`` map insult entries to weights, ``verbs`` the stems of verbs
    of harm (``THREAT_WEIGHT`` if not named); ``logistic`` holds the intercept and one weight
    per channel. Plain Python values, so it travels to the tasks."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    logistic: list[float] = field(default_factory=list)
    verbs: dict[str, float] = field(default_factory=dict)


def symbol_of(word: str, insult: bool) -> str:
    """The classes of a word, in the order of ``LETTERS``."""
    return "".join(c for c, words in zip(LETTERS, (CONTRASTS, NEGATIONS, REPORTS, THREATS, TARGETS))
                   if word in words) + ("I" if insult else "")


class Scorer:
    def __init__(self, grammar: Grammar):
        import ahocorasick
        self.grammar = grammar
        self.table = compose()
        self.automaton = ahocorasick.Automaton()
        entries = {**grammar.beginnings, **grammar.words, **dict.fromkeys(THREATS, 0.0)}
        for w in entries:
            self.automaton.add_word(w, len(w))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def insult(self, word: str) -> float:
        """Weight of the longest entry that the word is or begins with; 0 if none."""
        g = self.grammar
        if word in g.words:
            return g.words[word]
        for k in range(min(len(word) - 1, LONGEST), SHORTEST - 1, -1):
            if word[:k] in g.beginnings:
                return g.beginnings[word[:k]]
        return 0.0

    def clause(self, clause: str) -> dict[str, float]:
        """Run the automaton over one clause: weight by channel."""
        out: dict[str, float] = {}
        state, verb = 0, THREAT_WEIGHT
        for word in WORD.findall(clause):
            weight = self.insult(word)
            if word in THREATS:
                verb = self.grammar.verbs.get(THREATS[word], THREAT_WEIGHT)
            state, events = self.table[state, symbol_of(word, weight > 0)]
            for event in events:
                out[event] = out.get(event, 0.0) + (verb if event == "threat" else weight)
            if weight:
                out["hits"] = out.get("hits", 0.0) + 1
        return out

    def channels(self, text: str) -> list[float]:
        """Channel totals of a whole text. Only clauses that hold an entry are read word by
        word: no other clause can emit anything."""
        total = dict.fromkeys(CHANNELS, 0.0)
        text = text.lower()
        if not self.empty:
            done = 0
            for end, length in self.automaton.iter(text):
                start = end + 1 - length
                if start < done or (start and text[start - 1].isalpha()):
                    continue
                if not self._entry_at(text, start):
                    continue
                left = max(text.rfind(c, done, start) for c in CLAUSE_END) + 1
                cut = CLAUSE_CUT.search(text, end + 1)
                right = cut.start() if cut else len(text)
                for k, v in self.clause(text[max(left, done):right]).items():
                    total[k] += v
                done = right
        n_words = text.count(" ") + 1
        total["density"] = 100.0 * total["hits"] / (n_words + 10.0)
        return [total[c] for c in CHANNELS]

    def _entry_at(self, text: str, start: int) -> bool:
        word = WORD.match(text, start)
        return bool(word) and (word[0] in THREATS or self.insult(word[0]) > 0)

    def features(self, text: str) -> np.ndarray:
        return np.log1p(self.channels(text))

    def score(self, text: str) -> float:
        weights = self.grammar.logistic
        if not weights:
            return 0.0
        z = weights[0] + float(np.dot(weights[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def word_features(text: str) -> set[str]:
    """The text's words, their beginnings marked by a final ``*``, and the stems of its verbs of
    harm marked by a final ``~``."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w)
        if w in THREATS:
            out.add(THREATS[w] + "~")
        out.update(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


def choose_entries(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int,
                   ) -> tuple[dict[str, float], dict[str, float]]:
    """Insult entries from (entry, toxic documents, other documents) rows.

    Weight: smoothed log ratio of the two document frequencies. An entry gives way to one
    that is a letter longer (or to the whole word) and keeps nine tenths of its toxic
    documents, and to a shorter one that already has nearly its weight.
    """
    weight, pos = {}, {}
    for e, a, b in counts:
        if a >= MIN_SUPPORT and not e.endswith("~"):
            w = math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n_neg + 1))
            pos[e] = a
            if w >= MIN_WEIGHT and a * w >= 3 * MIN_WEIGHT * MIN_SUPPORT / 2:
                weight[e] = w
    outdone = set()
    for e, a in pos.items():
        stem = e[:-1]
        parents = [stem[:-1] + "*"] if e.endswith("*") else [e[:-1] + "*"]
        for parent in parents:
            if parent in weight and a >= 0.9 * pos[parent]:
                if e in weight:
                    outdone.add(parent)
    kept: dict[str, float] = {}
    for e in sorted(weight, key=lambda x: (len(x.rstrip("*")), x.endswith("*") is False, x)):
        if e in outdone:
            continue
        stem = e.rstrip("*")
        shorter = [kept[stem[:k] + "*"] for k in range(SHORTEST, len(stem) + 1) if stem[:k] + "*" in kept]
        if shorter and weight[e] < max(shorter) + 1.0:
            continue
        kept[e] = weight[e]
    return ({e: w for e, w in kept.items() if not e.endswith("*")},
            {e[:-1]: w for e, w in kept.items() if e.endswith("*")})


def verb_weights(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """A weight for each stem counted: its log ratio, drawn towards ``THREAT_WEIGHT`` as if
    ``THREAT_PRIOR`` more documents had shown that; never below 0."""
    out = {}
    for e, a, b in counts:
        if e.endswith("~"):
            ratio = math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n_neg + 1))
            out[e[:-1]] = max(0.0, (THREAT_PRIOR * THREAT_WEIGHT + (a + b) * ratio) / (THREAT_PRIOR + a + b))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> list[float]:
    """Ridge-regularised logistic weights by Newton steps; both labels count alike in total
    only through their numbers (no reweighting)."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[0] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + reg * w
        hess = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def _sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> list[tuple]:
    """(id, label) of at most the given numbers of labelled rows, by a hash of the id. Reads
    no text. A document with several labels counts as toxic if one says so."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    labelled = (labels.where("doc_id is not null and toxic is not null")
                .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(ids, "doc_id"))
    order = F.xxhash64(F.col("doc_id"), F.lit(8))
    out: list[tuple] = []
    for y, n in ((1, max_positive), (0, max_negative)):
        out += [(r[0], y) for r in labelled.where((F.col("toxic") > 0) == F.lit(y == 1))
                .orderBy(order, "doc_id").limit(n).select("doc_id").collect()]
    return out


def _count_words(docs: DataFrame, label_of: dict[int, int], half_of: dict[int, int]) -> list[tuple]:
    """``(entry, toxic documents of half 0, others of half 0, toxic of half 1, others of half 1)``
    for each word or beginning; counted in the tasks, then summed."""
    schema = pa.schema([("entry", pa.string())] + [(c, pa.int64()) for c in ("pos0", "neg0", "pos1", "neg1")])

    def rows_of(counters: list[Counter]) -> pa.RecordBatch:
        entries = list(set().union(*counters))
        return batch_of(schema, [entries, *([c[e] for e in entries] for c in counters)])

    def count(batches):
        counters = [Counter() for _ in range(4)]
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                counters[2 * half_of[doc_id] + 1 - label_of[doc_id]].update(word_features(text))
            if sum(map(len, counters)) > 1_000_000:
                yield rows_of(counters)
                counters = [Counter() for _ in range(4)]
        yield rows_of(counters)

    def may_count(pos, neg, halves) -> Column:
        """Only entries that can reach MIN_WEIGHT come back; the sample bounds their number."""
        n_pos = sum(y for d, y in label_of.items() if half_of[d] in halves)
        n_neg = sum(1 - y for d, y in label_of.items() if half_of[d] in halves)
        return (pos >= MIN_SUPPORT) & ((pos + 0.5) / (n_pos + 1) >= (neg + 0.5) / (n_neg + 1) * 2.0)

    c = {n: F.col(n) for n in schema.names[1:]}
    counts = (docs.mapInArrow(count, "entry string, pos0 long, neg0 long, pos1 long, neg1 long")
              .groupBy("entry").agg(*(F.sum(n).alias(n) for n in c))
              .where(F.col("entry").endswith("~") | may_count(c["pos0"], c["neg0"], {0})
                     | may_count(c["pos1"], c["neg1"], {1})
                     | may_count(c["pos0"] + c["pos1"], c["neg0"] + c["neg1"], {0, 1})))
    return [tuple(r) for r in counts.collect()]


def entries_of(counts: list[tuple], label_of: dict[int, int], half_of: dict[int, int], halves: set[int]) -> Grammar:
    """Entries and verb weights from the counts of the given halves; no logistic weights."""
    part = [(r[0], sum(r[1 + 2 * h] for h in halves), sum(r[2 + 2 * h] for h in halves)) for r in counts]
    n_pos = sum(y for d, y in label_of.items() if half_of[d] in halves)
    n_neg = sum(1 - y for d, y in label_of.items() if half_of[d] in halves)
    words, beginnings = choose_entries(part, n_pos, n_neg)
    return Grammar(words, beginnings, verbs=verb_weights([r for r in part if r[1] + r[2]], n_pos, n_neg))


def learn_grammar(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
                  max_negative: int = MAX_NEGATIVE) -> Grammar:
    """Learn entries and weights from ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``.

    ``max_positive`` and ``max_negative`` bound the labelled rows used. Without a label of
    either kind the grammar is empty and every score is 0.
    """
    python_tasks(docs.sparkSession)
    sample = _sample(docs, labels, max_positive, max_negative)
    label_of = dict(sample)
    if len(set(label_of.values())) < 2:
        return Grammar()
    chosen = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
              .where(F.col("doc_id").isin(list(label_of))))
    # Two halves of the sample, alternating in hash order within each label.
    half_of = {d: i % 2 for y in (0, 1) for i, d in enumerate(d for d, l in sample if l == y)}
    counts = _count_words(chosen, label_of, half_of)
    other = [entries_of(counts, label_of, half_of, {1 - h}) for h in (0, 1)]

    def channels(batches):
        scorers = [Scorer(g) for g in other]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            values = [scorers[half_of[d]].features(t).tolist() for d, t in zip(ids, texts(b))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = sorted(chosen.mapInArrow(channels, "doc_id long, x array<double>").collect(), key=lambda r: (r[0], r[1]))
    grammar = entries_of(counts, label_of, half_of, {0, 1})
    grammar.logistic = fit_logistic(np.array([r[1] for r in rows]), np.array([label_of[r[0]] for r in rows], float))
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "tox_score",
                   channels_col: str = "tox_channels") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) and ``channels_col`` (array<double>, in the order
    of ``CHANNELS``) added.

    Every whole text is scored; null and empty texts have no clause and get the score of no
    evidence. Columns that ``docs`` already has under these names are replaced; repeated rows
    and null ids stay as they are; an empty table gives an empty result.
    """
    python_tasks(docs.sparkSession)
    holder: list[Scorer] = []

    @F.pandas_udf("struct<score:double,channels:array<double>>")
    def score(series):
        import pandas as pd
        if not holder:
            holder.append(Scorer(grammar))
        s = holder[0]
        w = grammar.logistic
        rows = []
        for t in series:
            c = s.channels(t or "")
            z = w[0] + float(np.dot(w[1:], np.log1p(c))) if w else -math.inf
            rows.append((1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) if w else 0.0, c))
        return pd.DataFrame(rows, columns=["score", "channels"])

    scored = docs.withColumn(score_col, score(F.col(text_col).cast("string")))
    return scored.withColumns({channels_col: F.col(score_col)["channels"], score_col: F.col(score_col)["score"]})
