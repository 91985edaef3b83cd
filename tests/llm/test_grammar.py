"""The composed machine against reading clauses by hand; what its classes are worth on planted texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqbin.llm import grammar
from seqbin.llm.grammar import AIMED, INSULT, NEGATE, NEGATED, NOTHING, PLAIN, REPORTED, REPORTING, TARGETED, THREATEN, THREATENED


def _by_hand(clause):
    """Payments of a clause, by looking around every insult and threat."""
    paid, waits = [], []

    def recently(symbol, at, reach):
        return symbol in clause[max(at - reach, 0) : at]

    for at, symbol in enumerate(clause):
        changed = NOTHING
        if recently(NEGATE, at, grammar.NEGATION_REACH):
            changed = NEGATED
        elif recently(REPORTED, at, grammar.REPORT_REACH):
            changed = REPORTING
        aimed = recently(TARGETED, at, grammar.TARGET_REACH)
        if symbol == INSULT:
            paid.append(changed or (AIMED if aimed else PLAIN))
        elif symbol == THREATEN and (changed or aimed):
            paid.append(changed or THREATENED)
        elif symbol == THREATEN:
            waits.append(at)
        elif symbol == TARGETED:
            paid += [changed or THREATENED] * sum(at - w <= grammar.TARGET_REACH for w in waits)
            waits = []
    return sorted(paid)


def test_the_composed_machine_reads_clauses_as_by_hand():
    follow, pay, times = grammar.compose(grammar.MACHINES, grammar.payment)
    rng = random.Random(8)
    for _ in range(4000):
        clause = rng.choices(range(grammar.SYMBOLS), (3, 2, 2, 1, 1, 2), k=rng.randrange(1, 16))
        state, got = 0, []
        for symbol in clause:
            got += [int(pay[state, symbol])] * int(times[state, symbol])
            state = follow[state, symbol]
        assert sorted(got) == _by_hand(clause)


@pytest.mark.parametrize(
    "text", ["I will kill you", "I am killing you", "ich werde dich töten", "je vais te tuer", "te voy a matar"]
)
def test_threats_in_four_languages(text):
    scorer = grammar.Scorer(grammar.Grammar())
    assert scorer.features(text)[5] > 0 and scorer.score(text) > scorer.score("I will see you")


#: two insults or two threats each; what differs is who they are aimed at, and closed words of other clauses
PLANTED = {
    "toxic": "you are a {} and you {} here",
    "negated": "this is not a {} nor never {} here",
    "reported": "one said it is {} or wrote {} here",
    "threatened": "we will hurt you and destroy you",
    "plain": "storms will hurt the old road and destroy the stone bridge",
}
#: how many of each; insults are mostly meant, or they would not be learned as such
SHARES = {"toxic": 240, "negated": 20, "reported": 20, "threatened": 60, "plain": 900}
#: all other words of the clauses above, without an insult or a target near, in every text
OTHERS = "you see the lake. we are here. it is not late nor never a cold day. one said or wrote this and you rest. will you"


def _planted(rng, kind):
    insults = [f"zonk{c}" for c in "abcdef"]
    filler = " ".join(rng.choices("lake tree road house river cloud stone light".split(), k=30))
    text = PLANTED[kind]
    return f"{OTHERS}. {filler}. {text.format(*rng.sample(insults, text.count('{}')))}. {filler}"


def _corpus(spark, seed):
    rng = random.Random(seed)
    rows = [(_planted(rng, kind), kind) for kind, n in SHARES.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = [(i, int(k in ("toxic", "threatened"))) for i, (_, k) in enumerate(rows)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), [k for _, k in rows]


def test_the_classes_decide_on_planted_texts(spark):
    docs, labels, kinds = _corpus(spark, 3)

    def right(found):
        rows = [r for r in found.collect() if r.held_out]
        return {k: np.mean([r.predicted == int(k in ("toxic", "threatened")) for r in rows if kinds[r.doc_id] == k]) for k in PLANTED}

    got = right(grammar.toxicity(docs, labels))
    assert min(got.values()) > 0.9, got
    # with a neutral word for each closed one, negated or reported insults cannot be told from those that are meant
    closed = "|".join([*grammar.NEGATION, *grammar.REPORT, *grammar.TARGET])
    blind = docs.withColumn("text", F.regexp_replace("text", rf"\b({closed})\b", "lake"))
    got = right(grammar.toxicity(blind, labels))
    assert min(got["negated"], got["reported"]) < 0.5, got


def test_negation_and_report_never_raise_a_score(spark):
    """Also where every negated or reported insult of the sample stands in a toxic text."""
    rng = random.Random(5)
    rows = [(_planted(rng, kind), int(kind != "plain")) for kind in PLANTED for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    fitted = grammar.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    assert all(fitted.weights[i] <= bound for i, bound in grammar.BOUNDS.items())
