"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes: insult, threat, target, negation, reported speech, other. Five
transducers over classes, letter to letter, are composed into one deterministic
machine: negation turns an insult that follows it closely into a denied one, reported
speech turns the insults after it in the clause into quoted ones, threat turns a target
soon after a threatening word into a menace, target turns an insult near a person into
an aimed one, and the insult phrase turns an insult that closely follows another into a
piled one. The machine runs over the letters of each clause, and what it puts out has
a weight on its arc; so has the lexicon's arc from a word to its letter. A clause's
score is the sum along its path, and a document is judged by its matched clauses' scores
alone: the best, the sum, how many there are and how dense they are.

Which words are insults is learned: beginnings of words that are far more frequent in
toxic documents, each weighing its log odds. The outcomes' weights are learned by
logistic regression over documents, as arcs add up, and a document's probability from
its clauses' scores by logistic regression and small boosted trees, averaged.
"""

from __future__ import annotations

import math
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidied
from .learning import labelled_sample, sample_matrix, score_documents
from .quality import fit

THRESHOLD = 0.3
#: Closed classes of words, matched whole and without regard to case; insults are learned.
THREATS = ["kill", "hurt", "destroy", "punch", "shoot", "strangle", "stab", "burn", "töten", "umbringen", "schlagen", "tuer", "frapper", "détruire", "matar", "golpear", "destruir"]
TARGETS = ["you", "your", "he", "she", "him", "her", "they", "them", "these", "those", "people", "du", "dich", "ihr", "euch", "sie", "er", "tu", "toi", "vous", "il", "elle", "ils", "elles", "tú", "usted", "ustedes", "él", "ella", "ellos"]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "wasn't", "don't", "nobody", "nicht", "nie", "kein", "keine", "ne", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "called", "quoted", "claimed", "reported", "quote", "sagte", "sagt", "schrieb", "dit", "écrit", "dijo", "dice", "escribió"]
#: A learned stem has so many letters (or is a whole word of any length) and toxic
#: documents, share of them, and z score. Words that share more letters share these.
STEM, LEARN_DOCS, LEARN_SHARE, LEARN_Z = (3, 16), 8, 0.4, 6.0

OTHER, INSULT, THREAT, TARGET, NEG, REPORT, DENIED, QUOTED, AIMED, MENACE, PILED = range(11)
LETTERS = 11
#: What the composed machine puts out that counts as a match.
OUTCOMES = (INSULT, DENIED, QUOTED, AIMED, MENACE, PILED)

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


class Transducer:
    """Deterministic, one output letter per input letter, start state 0.

    ``arcs[state][letter] = (next state, output, weight)``; letters without an arc take
    the state's default next state, stay as they are and weigh nothing. Weights add up.
    """

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]], default: list[int]):
        self.arcs, self.default = arcs, default

    def step(self, state: int, letter: int) -> tuple[int, int, float]:
        return self.arcs[state].get(letter, (self.default[state], letter, 0.0))

    def run(self, letters) -> tuple[list[int], float]:
        """What comes out, and the weight of the path."""
        state, out, total = 0, [], 0.0
        for x in letters:
            state, y, w = self.step(state, x)
            out.append(y)
            total += w
        return out, total

    def compose(self, other: Transducer) -> Transducer:
        """First this one, then ``other`` on its output; only reachable states."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = {}
            for x in range(LETTERS):
                a2, mid, w = self.step(a, x)
                b2, out, v = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row[x] = (number[a2, b2], out, w + v)
            arcs.append(row)
        return Transducer(arcs, [0] * len(arcs))


def within(opens: tuple[int, ...], closes: dict[int, int], reach: int | None, weights: dict[int, float]) -> Transducer:
    """After a letter of ``opens``, for ``reach`` letters (None: the rest), letters are
    rewritten as ``closes`` says, by arcs that weigh what ``weights`` has for the outcome.
    A letter that both opens and closes opens anew."""
    arc = lambda to, y: (to, y, weights.get(y, 0.0))
    if reach is None:
        return Transducer([{x: (1, x, 0.0) for x in opens}, {x: arc(1, y) for x, y in closes.items()}], [0, 1])
    arcs: list[dict] = [{x: (reach, x, 0.0) for x in opens}]
    for left in range(1, reach + 1):
        arcs.append({x: (reach, x, 0.0) for x in opens} | {x: arc(reach if x in opens else left - 1, y) for x, y in closes.items()})
    return Transducer(arcs, [0, *range(reach)])


def transducers(weights: dict[int, float]) -> list[Transducer]:
    """Negation, reported speech, threat phrase, target, insult phrase, in their order.
    Insults that none of them rewrites weigh what a plain one does, on the last one's arcs."""
    last = within((INSULT, AIMED), {INSULT: PILED}, 3, weights)
    for row in last.arcs:
        to, y, w = row[INSULT]
        row[INSULT] = (to, y, weights.get(y, 0.0))
    return [
        within((NEG,), {INSULT: DENIED}, 3, weights),
        within((REPORT,), {INSULT: QUOTED}, None, weights),
        within((THREAT,), {TARGET: MENACE}, 3, weights),
        within((TARGET, MENACE), {INSULT: AIMED}, 4, weights),
        last,
    ]


def grammar(weights: dict[int, float]) -> Transducer:
    machine, *rest = transducers(weights)
    for t in rest:
        machine = machine.compose(t)
    return machine


class Matcher:
    """Matches a text's clauses. ``stems`` maps beginnings of longer words, or whole
    words followed by a space, to log odds; ``weights`` outcomes to theirs."""

    n_features = 6

    def __init__(self, stems: dict[str, float], weights: dict[int, float]):
        self.classes = {w: c for words, c in ((TARGETS, TARGET), (NEGATIONS, NEG), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}
        self.stems = stems
        self.lengths = sorted({len(x) for x in stems if x[-1] != " "}, reverse=True)
        machine = grammar(weights)
        self.next, self.out, self.weight = ([[row[x][i] for x in range(LETTERS)] for row in machine.arcs] for i in range(3))
        self.found = None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def stem_of(self, word: str) -> str | None:
        """The stem that makes a word an insult: the word itself, or its longest beginning."""
        if f"{word} " in self.stems:
            return f"{word} "
        return next((word[:k] for k in self.lengths if len(word) > k and word[:k] in self.stems), None)

    def _finder(self):
        """Finds texts that may match: those that hold a stem or a threat anywhere."""
        auto = ahocorasick.Automaton()
        for x in [*THREATS, *(x.rstrip(" ") for x in self.stems)]:
            auto.add_word(x, True)
        auto.make_automaton()
        return lambda text: next(auto.iter(text), None) is not None

    def clauses(self, text: str):
        """(score, lexical part of it, outcomes) of each matched clause of a lower-case text."""
        if self.found is None:
            self.found = self._finder()
        if not self.found(text):
            return
        get, nxt, out, weight = self.classes.get, self.next, self.out, self.weight
        for clause in _CLAUSE.split(text):
            if not self.found(clause):
                continue
            state, score, lexical, outcomes = 0, 0.0, 0.0, []
            for w in _WORD.findall(clause):
                c = get(w, OTHER)
                if c == OTHER and (stem := self.stem_of(w)):
                    c = INSULT
                    lexical += self.stems[stem]
                score += weight[state][c]
                o = out[state][c]
                state = nxt[state][c]
                if o in OUTCOMES:
                    outcomes.append(o)
            if outcomes:
                yield score + lexical, lexical, outcomes

    def counts(self, text: str) -> list[float]:
        """The lexical weight of all matched clauses, and how often each outcome came."""
        total, seen = 0.0, [0.0] * len(OUTCOMES)
        for _, lexical, outcomes in self.clauses(text.lower()):
            total += lexical
            for o in outcomes:
                seen[OUTCOMES.index(o)] += 1
        return [total, *seen]

    def features(self, text: str) -> list[float]:
        low = text.lower()
        scores = [s for s, *_ in self.clauses(low)]
        if not scores:
            return [0.0] * self.n_features
        words = low.count(" ") + low.count("\n") + 1
        signed = math.copysign(math.log1p(abs(sum(scores))), sum(scores))
        return [1.0, max(scores), signed, math.log1p(len(scores)), sum(scores) / len(scores), 100 * sum(scores) / (words + 20)]


def arc_weights(x: np.ndarray, y: np.ndarray) -> dict[int, float]:
    """Of each outcome, from documents' ``counts``, within 4 either way."""
    w = logistic(np.hstack([x[:, :1] / 10, np.minimum(x[:, 1:], 5)]), y)
    return {o: float(np.clip(v, -4, 4)) for o, v in zip(OUTCOMES, w[1:])}


def _beginnings(words: set[str]) -> set[str]:
    """Proper beginnings, of STEM letters, of the words, and the words themselves
    followed by a space."""
    return {w[:k] for w in words for k in range(STEM[0], min(len(w) - 1, STEM[1]) + 1)} | {f"{w} " for w in words if len(w) >= STEM[0]}


def _kind(words: set[str]) -> int:
    """The least hash of a text's words: near copies mostly have the same."""
    return min((zlib.crc32(w.encode()) for w in words), default=0)


def learned_stems(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words far more frequent in toxic documents than in others, with
    the logarithm of their odds; nothing below one that is clearer.

    Documents of one kind and label count once, so that a group of copies doesn't make
    each of its words a stem. All stems are counted and tested on the executors; those
    that pass reach the driver.
    """

    def run(batches):
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                found = ["", *_beginnings(words)]  # the empty one counts all
                n = len(found)
                yield pa.record_batch([pa.array(found, pa.string()), pa.array([int(label)] * n, pa.int32()), pa.array([_kind(words)] * n, pa.int64())], names=["stem", "label", "kind"])

    scratch = Scratch(sample.sparkSession)
    kinds = sample.mapInArrow(tidied(run), "stem string, label int, kind long").distinct()
    counted = scratch.keep(kinds.groupBy("stem").agg(F.sum("label").alias("bad"), F.count("*").alias("n")))
    every = counted.where("stem = ''").first()
    rate = every.bad / every.n if every else 0.0
    z = (F.col("bad") - rate * F.col("n")) / F.sqrt(F.greatest(rate * (1 - rate) * F.col("n"), F.lit(1e-9)))
    clear = []
    for r in counted.where((F.col("stem") != "") & (F.col("bad") >= LEARN_DOCS) & (F.col("bad") >= LEARN_SHARE * F.col("n")) & (z >= LEARN_Z)).collect():
        # Log-likelihood gain over the base rate: favours stems that explain much.
        share = r.bad / r.n
        gain = r.bad * math.log(share / rate) + ((r.n - r.bad) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0)
        clear.append((-gain, -len(r.stem), r.stem, r.bad, r.n))
    scratch.drop(counted)
    taken: dict[str, tuple[int, int]] = {}
    for *_, stem, bad, n in sorted(clear):
        if any(stem.startswith(x) for x in taken):
            continue
        # A wider stem must still say something beyond the commonest of the clearer ones below it.
        below = max((taken[x] for x in taken if x.startswith(stem)), default=(0, 0))
        rest = bad - below[0]
        if rest >= LEARN_DOCS and rest >= LEARN_SHARE / 2 * max(n - below[1], rest):
            taken[stem] = bad, n
    return {x: math.log((bad + 0.5) / (n - bad + 0.5)) for x, (bad, n) in taken.items()}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with a ridge.

    Two invented rows, one of each label with all features at rest, keep the fit
    defined without rows or with one label only.
    """
    x = np.vstack([np.hstack([x, np.ones((len(x), 1))]), *[np.eye(x.shape[1] + 1)[-1:]] * 2])
    y = np.append(y, [0.0, 1.0])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame):
    """(matcher, a function from features to probabilities), fitted on the labelled sample."""
    sample = Scratch(docs.sparkSession).keep(labelled_sample(docs, labels, "toxic"))
    stems = learned_stems(sample)
    x, y = sample_matrix(sample, Matcher(stems, {}).counts, 1 + len(OUTCOMES))
    matcher = Matcher(stems, arc_weights(x, y))
    x, y = sample_matrix(sample, matcher.features, Matcher.n_features)
    w, trees = logistic(x, y), fit(x, y, trees=40, depth=3)

    def predict(x):
        line = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) if len(x) else np.empty(0)
        return (line + trees.predict(x)) / 2

    return matcher, predict


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs(doc_id, text)``.

    Null and empty texts match nothing and get the score of a text without
    matches. Repeated rows score alike; other columns are ignored. Without labels, or
    with one label only, all rows score alike; an empty table has no rows.
    """
    matcher, predict = train_toxicity(docs, labels)
    return score_documents(docs, matcher.features, predict, THRESHOLD, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_toxicity`` of documents, learned from labels."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
