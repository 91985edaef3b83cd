"""Toxicity by a weighted finite-state grammar over clauses.

Small machines for negation, reported speech, targets and waiting threats read the
words of a clause, each as one symbol, and say what holds at a word; a weighted
transducer for insults and threats turns that into payments. :func:`compose` makes one
table of them. Every insult or threat pays its weight, changed by what holds. A threat
without a target before it waits for one and pays when it comes. A clause (text between
sentence marks) scores the sum of its payments; words alone do not.

Insult words are learned: a word, or a stem (the first letters of words), is
taken up if it occurs in significantly more toxic than other training documents.
The factors for negation, report and target come from the same documents by a
logistic fit of the clause features, in which what is negated or reported never
raises a score.

Defined cases: a null or empty text scores like one without any clause; long texts are read
whole, word by word; a null doc_id, or rows that repeat one, are scored like any other; without
labels of both classes the grammar knows no insults, only threats; an empty table gives no
rows; other columns are never read, and stay in :func:`drop_toxic`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.llm.memory import give_back
from seqbin.staging import stage

# fixed values: closed word classes of the grammar
NEGATION = "not no never nobody nothing isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca".split()
REPORT = "said says say saying claimed claims wrote writes quoted quote reported reports called according alleged sagte schrieb dit dijo".split()
TARGET = (
    "you your you're u he she they them him her his their yours yourself people "
    "du ihr sie dich dir euch ihn ihm ihnen tu vous toi te les leur lui eux usted ustedes ti os"
).split()
THREAT = (
    "kill kills killed killing murder murders murdered murdering stab stabs stabbed stabbing strangle strangled strangling "
    "burn burned burning destroy destroyed destroying hurt hurts hurting shoot shoots shooting beat beats beating hang hanged hanging "
    "töten töte tötet umbringen umbringt ermorden ermorde ermordet erschießen erschieße erschießt erwürgen erwürge erstechen ersteche "
    "verprügeln verprügle verbrennen verbrenne verletzen verletze vernichten vernichte "
    "tuer tuerai tuera tuerons assassiner assassinerai égorger égorgerai étrangler étranglerai poignarder poignarderai frapper frapperai "
    "brûler brûlerai blesser blesserai détruire détruirai "
    "matar mataré mataremos matarte matarlo matarlos asesinar asesinaré apuñalar apuñalaré estrangular estrangularé golpear golpearé "
    "quemar quemaré lastimar lastimaré destruir destruiré"
).split()

#: symbols of the composed machine
OTHER, INSULT, THREATEN, NEGATE, REPORTED, TARGETED = range(6)
SYMBOLS = 6
#: words for which a negation, a target or a report stays in effect
NEGATION_REACH, TARGET_REACH, REPORT_REACH = 3, 4, 6
#: lengths of stems that may be learned
STEMS = range(2, 8)
#: documents of the fit; the smallest by hash of doc_id are taken, so every run takes the same
SAMPLE_ROWS = 20_000
#: upper bounds of weights (by place in ``Grammar.weights``): what is negated or reported raises no score
BOUNDS = {2: 0.0, 3: 0.0}
#: log-likelihood ratio an entry needs
SIGNIFICANT = 18.0

_WORD = regex.compile(r"[\p{L}\p{M}']+|[.!?;:\n]+")


@dataclass
class Grammar:
    """Lexicon and weights; small, and of bounded size."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: bias, plain, negated, reported, targeted, threats, density, any
    weights: tuple[float, ...] = (-3.0, 1.0, -0.5, -0.2, 1.2, 0.8, 1.0, 2.0)


#: what a payment is: nothing, an insult as such, negated, reported or with a target, a threat
NOTHING, PLAIN, NEGATED, REPORTING, AIMED, THREATENED = range(6)


def recent(symbol: int, reach: int) -> np.ndarray:
    """Machine that holds for ``reach`` words after ``symbol``: next state by (state, symbol), 0 = does not hold."""
    table = np.repeat(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], SYMBOLS, axis=1)
    table[:, symbol] = reach
    return table


def waiting_threats() -> np.ndarray:
    """Machine of the threats that wait for a target: bit i set for one i words back, all paid by a target."""
    states = 1 << TARGET_REACH
    table = np.repeat((np.arange(states) << 1)[:, None] % states, SYMBOLS, axis=1)
    table[:, THREATEN] |= 1
    table[:, TARGETED] = 0
    return table


def payment(symbol: int, negated: int, reported: int, targeted: int, waiting: int) -> tuple[int, int]:
    """Payment class and number of payments at a word; the other arguments are the machines' states before it."""
    changed = NEGATED if negated else REPORTING if reported else NOTHING
    if symbol == INSULT:
        return changed or (AIMED if targeted else PLAIN), 1
    if symbol == THREATEN and (changed or targeted):
        return changed or THREATENED, 1
    if symbol == TARGETED and waiting:
        return changed or THREATENED, waiting.bit_count()
    return NOTHING, 0


def compose(machines: list[np.ndarray], output) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(next state, payment class, payments)`` by state and symbol of machines that read together.

    States are those that can be reached from all machines' first states; state 0 is the start.
    """
    number = {(0,) * len(machines): 0}
    rows: list[list[tuple[int, int, int]]] = []
    queue = list(number)
    for state in queue:  # grows while it is read
        row = []
        for symbol in range(SYMBOLS):
            pay, times = output(symbol, *state)
            # a threat that was paid at once does not wait
            seen = OTHER if symbol == THREATEN and pay != NOTHING else symbol
            after = tuple(int(m[s, seen]) for m, s in zip(machines, state, strict=True))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append((number[after], pay, times))
        rows.append(row)
    table = np.array(rows)
    return table[:, :, 0], table[:, :, 1], table[:, :, 2]


MACHINES = [recent(NEGATE, NEGATION_REACH), recent(REPORTED, REPORT_REACH), recent(TARGETED, TARGET_REACH), waiting_threats()]
_FOLLOW, _PAY, _TIMES = (table.tolist() for table in compose(MACHINES, payment))
_CLOSED = (
    dict.fromkeys(THREAT, THREATEN)
    | dict.fromkeys(TARGET, TARGETED)
    | dict.fromkeys(REPORT, REPORTED)
    | dict.fromkeys(NEGATION, NEGATE)
)

#: one shared value for all words without a learned weight
_WEIGHTLESS = [(symbol, 1.0) for symbol in range(6)]


def _features(word: str) -> list[str]:
    """The word itself (``=word``) and its stems (``stem*``)."""
    return ["=" + word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Scorer:
    """Features and scores of single texts under a grammar."""

    def __init__(self, grammar: Grammar, remember: int = 50_000):
        self.grammar = grammar
        self.remember = remember
        self.seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a lower-case word."""
        found = self.seen.get(word)
        if found is None:
            weight = max(
                [self.grammar.words.get(word, 0.0)]
                + [self.grammar.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n]
            )
            found = (INSULT, weight) if weight > 0 else _WEIGHTLESS[_CLOSED.get(word, OTHER)]
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """``[1, plain, negated, reported, targeted, threats, density, any]`` of a text."""
        sums = [0.0] * 6
        words = paid = 0
        symbol, seen = self.symbol, self.seen
        clause: list[tuple[int, float]] = []
        loaded = False

        def close() -> int:
            state, hits = 0, 0
            for kind, weight in clause:
                pay = _PAY[state][kind]
                if pay:
                    times = _TIMES[state][kind]
                    sums[pay] += weight * times
                    hits += times * (pay in (1, 4, 5))
                state = _FOLLOW[state][kind]
            return hits

        for word in _WORD.findall((text or "").lower()):
            if word[0] in ".!?;:\n":
                if loaded:
                    paid += close()
                clause, loaded = [], False
                continue
            words += 1
            found = seen.get(word) or symbol(word)
            clause.append(found)
            loaded = loaded or found[0] in (INSULT, THREATEN)
        if loaded:
            paid += close()
        squashed = [math.log1p(x) for x in sums[1:]]
        return [1.0, *squashed, 100.0 * paid / words if words else 0.0, float(sums[1] + sums[4] > 0)]

    def score(self, text: str | None) -> float:
        x = self.features(text)
        z = sum(a * b for a, b in zip(self.grammar.weights, [*x[:6], min(x[6], 10.0), x[7]], strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _lexicon(counts: list, positives: int, negatives: int) -> tuple[dict, dict]:
    """Words and stems of ``(feature, toxic, other)`` rows, with log odds as weights."""
    words, stems = {}, {}
    base = (positives + 0.5) / (positives + negatives + 1)
    for feature, pos, neg in counts:
        weight = math.log((pos + 0.5) / (neg + 0.5)) - math.log(base / (1 - base))
        if weight < 2.0 or pos < 0.5 * (pos + neg):
            continue
        if feature[0] == "=":
            words[feature[1:]] = weight
        else:
            stems[feature[:-1]] = weight
    # a longer stem or a word adds nothing to a stem that is as clear
    stems = {
        s: w for s, w in stems.items() if not any(stems.get(s[:n], -9) >= w - 0.7 for n in STEMS if n < len(s))
    }
    return words, stems


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights drawn towards the grammar's defaults, by Newton steps.

    The factors in ``BOUNDS`` are at most what stands there: one that would pass its
    bound is held at it and the others are fitted again.
    """
    w = _newton(x, y, {})
    held = {i: bound for i, bound in BOUNDS.items() if w[i] > bound}
    return _newton(x, y, held) if held else w


def _newton(x: np.ndarray, y: np.ndarray, held: dict[int, float]) -> np.ndarray:
    free = [i for i in range(x.shape[1]) if i not in held]
    prior = np.array(Grammar().weights)
    strength = np.full(len(prior), 0.5)
    strength[0] = 0.05
    w = prior.copy()
    w[list(held)] = list(held.values())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        w[free] -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Fit a grammar to at most ``sample_rows`` labelled documents.

    ``docs (doc_id, text)``, ``labels (doc_id, toxic)``. Rows without a label, a
    doc_id or a text are left out. Of several labels of one document the largest
    counts. Without rows of both classes the result is the default grammar, which
    knows no insults.
    """
    labels = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most sample_rows rows of 12 bytes
    sample = stage(texts.filter("text is not null").join(F.broadcast(labels), "doc_id"), "labelled")
    classes = {bool(r.toxic): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = classes.get(True, 0), classes.get(False, 0)
    if not pos or not neg:
        return Grammar()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features = {f for w in set(_WORD.findall(text.lower())) if w[0] not in ".!?;:\n" for f in _features(w)}
                for f in features:
                    tally.setdefault(f, [0, 0])[toxic <= 0] += 1
                if len(tally) > 400_000:
                    yield _tally(tally)
                    tally = {}
            yield _tally(tally)

    counted = (
        sample.select("text", "toxic")
        .mapInArrow(found, "feature string, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") * neg > F.col("neg") * pos)
    )

    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    k1, k2 = F.col("pos").cast("double"), F.col("neg").cast("double")
    share, total = (k1 + k2) / (pos + neg), float(pos + neg)
    ratio = 2 * (
        term(k1, share * pos) + term(k2, share * neg)
        + term(pos - k1, (1 - share) * pos) + term(neg - k2, (1 - share) * neg)
    )
    # all of them: the sample bounds the table, and stems are pruned only when none is missing
    best = (
        counted.filter((k1 + k2 < total) & (k1 >= k2))
        .filter(ratio >= SIGNIFICANT)
        .select("feature", "pos", "neg")
        .collect()
    )
    words, stems = _lexicon([(r.feature, r.pos, r.neg) for r in best], pos, neg)
    grammar = Grammar(words, stems)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    # at most sample_rows rows of eight numbers
    rows = sample.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()
    x = np.array([r.x for r in rows])
    x[:, 6] = np.minimum(x[:, 6], 10.0)
    y = np.array([float(r.toxic > 0) for r in rows])
    order = np.lexsort([*x.T, y])
    grammar.weights = tuple(float(v) for v in _fit(x[order], y[order]))
    return grammar


def _tally(tally: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(list(tally), pa.string()),
            pa.array([v[0] for v in tally.values()], pa.int64()),
            pa.array([v[1] for v in tally.values()], pa.int64()),
        ],
        names=["feature", "pos", "neg"],
    )


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``(doc_id, text)``.

    The score is the model's probability that the document is toxic; a null or
    empty text gets that of a text without any clause. Only the text is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
            del batch, scores
            give_back()

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return (
        docs.select(ids, F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: trained outside of fold 0, scored everywhere.

    A null doc_id is in no fold (held_out null).
    """
    grammar = train(docs, labels.filter(fold() != 0), sample_rows)
    return score(docs, grammar).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows whose text the grammar rejects; all columns stay."""
    grammar = train(docs, labels.filter(fold() != 0), sample_rows)
    # the same column that Spark takes for "text", in any letter case
    place = [name.lower() for name in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for batch in batches:
            texts = batch.column(place)
            keep = pa.array([scorer.score(t.as_py()) < 0.5 for t in texts], pa.bool_())
            yield batch.filter(keep)
            # not held while the next one is read
            del batch, texts, keep
            give_back()

    return docs.mapInArrow(run, docs.schema)
