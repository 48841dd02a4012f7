"""Operator 8: the composed automaton against its parts, the shortcut against every clause."""

import random

import pytest

from crashlens.llm import toxicity_grammar as op

GRAMMAR = op.Grammar({"moron": 5.0, "you": 2.5}, {"lowei": 3.0}, [-3.0, 1, 1, 1, 1, 1, 1, 1], {"kill": 4.0})


def test_product_equals_the_cascade():
    machines, table = op.transducers(), op.compose()
    rng = random.Random(8)
    for _ in range(300):
        state, states = 0, tuple(m.start for m in machines)
        for _ in range(25):
            symbol = "".join(c for c in op.LETTERS if rng.random() < 0.2)
            state, events = table[state, symbol]
            states, plain = op.run_cascade(machines, states, symbol)
            assert events == plain


def every_clause(scorer, text):
    """All clauses read word by word, by the machines themselves and not by their product."""
    total = dict.fromkeys(op.CHANNELS, 0.0)
    machines = op.transducers()
    for clause in op.CLAUSE_CUT.split(text.lower()):
        states, verb = tuple(m.start for m in machines), op.THREAT_WEIGHT
        for word in op.WORD.findall(clause):
            weight = scorer.insult(word)
            if word in op.THREATS:
                verb = scorer.grammar.verbs.get(op.THREATS[word], op.THREAT_WEIGHT)
            states, events = op.run_cascade(machines, states, op.symbol_of(word, weight > 0))
            for e in events:
                total[e] += verb if e == "threat" else weight
            total["hits"] += weight > 0
    total["density"] = 100.0 * total["hits"] / (text.count(" ") + 11.0)
    return [total[c] for c in op.CHANNELS]


@pytest.mark.parametrize("seed", range(5))
def test_shortcut_equals_reading_every_clause(seed):
    rng = random.Random(seed)
    words = ["moron", "morons", "loweight", "lowei", "xlowei", "you", "not", "but", "said", "kills", "killed", "tue",
             "te", "the", "guide", "never", "she", "a1moron", "d'moron", "it's", "été", "9lowei"]
    scorer, found = op.Scorer(GRAMMAR), 0
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", " ", " ", ". ", "\n", "; ", "-", "_"])
                       for _ in range(rng.randrange(0, 40)))
        got = scorer.channels(text)
        assert got == pytest.approx(every_clause(scorer, text))
        found += got[op.CHANNELS.index("threat")] > 0
    assert found > 20


@pytest.mark.parametrize("text", ["I will kill you", "he kills you", "she killed them", "je te tue", "ich töte dich",
                                  "te mato", "they shot her", "du wirst geschlagen"])
def test_threats_in_their_forms(text):
    assert op.Scorer(op.Grammar()).channels(text)[op.CHANNELS.index("threat")] == op.THREAT_WEIGHT


@pytest.mark.parametrize("text, channel", [
    ("a moron", "plain"), ("you are such a moron", "targeted"), ("she is not a moron", "negated"),
    ("not this one or that or any moron", "plain"),          # beyond the negation's reach
    ("not today but moron", "plain"), ("he said she is a moron", "reported"),
    ("he said that she is not a moron", "reported"), ("he said so but moron it is", "targeted")])
def test_scope_of_negation_and_report(text, channel):
    got = op.Scorer(op.Grammar({"moron": 5.0})).channels(text)
    assert {c for c, v in zip(op.CHANNELS, got) if v and c not in ("hits", "density")} == {channel}


@pytest.mark.parametrize("text", ["I will not kill you", "he said he kills you", "kill the old and very slow process for you",
                                  "the mate of mine", "burn"])
def test_no_threat(text):
    assert op.Scorer(op.Grammar()).channels(text)[op.CHANNELS.index("threat")] == 0


def test_verbs_are_drawn_towards_the_prior():
    got = op.verb_weights([("kill~", 60, 0), ("burn~", 0, 60), ("stab~", 1, 0), ("word", 9, 0)], 100, 100)
    assert got["kill"] > 4 and got["burn"] == 0 and abs(got["stab"] - op.THREAT_WEIGHT) < 0.6 and len(got) == 3
