"""Toxicity scores from a weighted finite-state grammar of clauses.

Words are mapped to symbols by a lexicon: insults (whole words and word beginnings, with weights), threats, intent,
targets, negations, verbs of reported speech and quotation marks. Five weighted transducers are composed in sequence, each
reading what the one before it writes: the threat machine turns a verb after an intent into a hit, the insult machine an
insult, the negation machine weakens hits within its reach, the machine of reported speech those that are only told, and
the target machine strengthens hits in clauses that are aimed at someone. Weights of the arcs multiply along the cascade and with the
lexicon's; a clause's hits add up. A text's score comes from its matched clauses by a logistic regression.

Insult words beyond the given ones and their weights are learnt from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import stored, texts_of

# Symbols of the grammar, and AIMED, by which the target machine says that it applies to the hits before it.
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE, AIMED = range(9)
#: Hits are symbols from here on, with marks for what the machines have found out.
HIT, THREATENED, NEGATED, REPORTED, TARGETED = 16, 1, 2, 4, 8
HITS = [HIT | marks for marks in range(16)]

#: Given words of each symbol, in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting dumb filth imbecile vermin idioten dummkopf abschaum trottel versager connard salaud ordure imbécile abruti idiota imbécil basura estúpido escoria",
    THREAT: "kill hurt destroy beat stab shoot strangle töten umbringen verletzen vernichten tuer frapper détruire matar golpear destruir",
    INTENT: "will gonna ll shall must should going werde werden soll vais va vas allons voy vamos debe",
    TARGET: "you your yours u he she they them him her his their du dich dir ihr euch dein sie er tu toi vous te il elle ils ton votre tú ti usted ustedes él ella ellos su",
    NEGATION: "not never no n't don't isn't aren't wasn't nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says say wrote writes called calls quote quoted claims claimed reported sagte sagt schrieb nannte dit écrit déclaré appelé dijo dice escribió llamó",
}
#: Weight of a given insult for which there are too few labelled rows.
GIVEN_WEIGHT = 3.0
NEGATION_REACH = 3

#: Weights of arcs: of an insult right after another, of a hit by how many words the negation is away, of a reported hit, and
#: of one that is aimed at someone.
PILED, NEGATED_WEIGHT, REPORTED_WEIGHT, TARGET_WEIGHT = 1.25, (0.1, 0.2, 0.4), 0.3, 1.5

#: Labelled rows that learning takes at most, and what the lexicon holds at most.
SAMPLE_ROWS, LEXICON = 8000, 4096

_CLAUSE = re.compile(r"[.!?;:|\n]+")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"«»“”„]")
_QUOTES = set('"«»“”„')
PREFIX = range(3, 9)
FEATURES = 9


class Transducer(NamedTuple):
    """arcs[state, symbol] is (next state, symbol written, weight); where an arc is missing, otherwise[state] is the next
    state (or the same), and the symbol is written as it is, with weight 1. State 0 begins a clause."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    otherwise: dict[int, int]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol, 1.0)


def _transducers() -> list[Transducer]:
    threat = Transducer({(0, INTENT): (1, INTENT, 1.0), (0, THREAT): (0, OTHER, 1.0), (1, THREAT): (0, HIT | THREATENED, 1.0), (1, QUOTE): (0, QUOTE, 1.0)}, {})
    insult = Transducer({(0, INSULT): (1, HIT, 1.0), (1, INSULT): (1, HIT, PILED)}, {1: 0})
    arcs = {(state, NEGATION): (1, NEGATION, 1.0) for state in range(NEGATION_REACH + 1)}  # state: words since a negation, 0 without one
    after = {state: state + 1 if state < NEGATION_REACH else 0 for state in range(1, NEGATION_REACH + 1)}
    arcs |= {(state, h): (after[state], h | NEGATED, NEGATED_WEIGHT[state - 1]) for state in after for h in HITS}
    negation = Transducer(arcs, after)
    # 0: neither, 1: a verb of reporting, 2: quoted, 3: quoted after such a verb, or with one in the quotation
    steps = {(0, REPORT): 1, (0, QUOTE): 2, (2, QUOTE): 0, (1, QUOTE): 3, (3, QUOTE): 1, (2, REPORT): 3}
    said = {(state, symbol): (to, symbol, 1.0) for (state, symbol), to in steps.items()}
    reported = Transducer(said | {(state, h): (state, h | REPORTED, REPORTED_WEIGHT) for state in (1, 3) for h in HITS}, {})
    # 0: nothing yet, 1: a target, 2: a hit without one
    aim = {(0, TARGET): (1, TARGET, 1.0), (2, TARGET): (1, AIMED, TARGET_WEIGHT)}
    target = Transducer(aim | {(0, h): (2, h, 1.0) for h in HITS} | {(1, h): (1, h | TARGETED, TARGET_WEIGHT) for h in HITS}, {})
    return [threat, insult, negation, reported, target]


def compose(machines: list[Transducer]) -> dict[tuple[int, int], tuple[int, int, float]]:
    """One machine for the cascade: its states are those that the machines reach together, what the last one writes is
    written, and weights are multiplied."""
    start = (0,) * len(machines)
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for symbol in range(AIMED):
            after, out, weight = [], symbol, 1.0
            for machine, state in zip(machines, states, strict=True):
                state, out, w = machine.step(state, out)
                after.append(state)
                weight *= w
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                todo.append(tuple(after))
            arcs[number[states], symbol] = (number[tuple(after)], out, weight)
    return arcs


GRAMMAR = compose(_transducers())


class Lexicon:
    """Symbols and weights of words; what it has worked out is kept, within bounds, by each task."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.given = {w: s for s, words in WORDS.items() for w in words.split()}
        self.known: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            learnt = max([self.weights.get("^" + word[:k], 0.0) for k in PREFIX if k <= len(word)] + [self.weights.get(word, 0.0)])
            symbol = self.given.get(word, OTHER)
            if symbol in (OTHER, INSULT) and (learnt or symbol):
                found = (INSULT, learnt or GIVEN_WEIGHT)
            else:
                found = (QUOTE if word in _QUOTES else symbol, 0.0)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found


def hits_of(read: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """(marks, weight) of the hits among a clause's symbols with their lexical weights."""
    state, hits = 0, []
    for symbol, weight in read:
        state, out, arc = GRAMMAR[state, symbol]
        if out >= HIT:
            hits.append((out - HIT, (weight or GIVEN_WEIGHT) * arc))
        elif out == AIMED:
            hits = [(marks, w) if marks & TARGETED else (marks | TARGETED, w * arc) for marks, w in hits]
    return hits


def clauses(text: str, lexicon: Lexicon):
    """(hits, tokens) of each clause; see hits_of()."""
    look = lexicon.look_up
    for clause in _CLAUSE.split(text.lower()):
        read = [look(t) for t in _TOKEN.findall(clause)]
        yield hits_of(read) if any(s in (INSULT, THREAT) for s, _ in read) else [], len(read)


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """Of the matched clauses: plain weight, the heaviest, targeted, negated and reported weight, threats, counts and shares."""
    plain = heaviest = target = negated = reported = threats = 0.0
    matched = tokens = hits_all = 0
    for hits, n in clauses(text, lexicon):
        tokens += n
        weight = 0.0
        for marks, w in hits:
            if marks & NEGATED:
                negated += w
            elif marks & REPORTED:
                reported += w
            else:
                weight += w
                target += w if marks & TARGETED else 0.0
                threats += bool(marks & THREATENED)
        plain += weight
        heaviest = max(heaviest, weight)
        matched += bool(weight)
        hits_all += len(hits)
    return np.array([*map(math.log1p, (plain, heaviest, target, negated, reported, threats, matched)), math.log1p(100 * plain / (tokens + 20)), math.log1p(1000 * hits_all / (tokens + 100))])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights, the last a constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: np.ndarray


def _word_counts(batches):
    """(term, toxic texts, other texts) within a partition; terms are words and, marked ^, word beginnings."""
    import pyarrow as pa

    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_TOKEN.findall((text or "").lower()))
            counts[bool(toxic)].update(words | {"^" + w[:k] for w in words for k in PREFIX if len(w) >= k})
    bad, good = counts[True], counts[False]
    terms = list(bad | good)  # what only other texts of a partition have may be in toxic ones of another
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], names=["term", "bad", "good"])


def learn_lexicon(sample: DataFrame, least: int = 3) -> dict[str, float]:
    """Terms that toxic texts hold far more often than others, and the logarithm of how much more often."""
    sizes = {bool(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return {}
    counts = sample.coalesce(8).mapInArrow(_word_counts, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.1) / (bad + 1.0) / ((F.col("good") + 1.0) / (good + 1.0)))
    found = counts.withColumn("odds", odds).where((F.col("bad") >= least) & (F.col("odds") > 2.5))
    rows = found.orderBy(F.desc(F.col("bad") * F.col("odds")), "term").limit(LEXICON).collect()
    return {r["term"]: min(6.0, r["odds"]) for r in rows}


def train(docs: DataFrame, labels: DataFrame, may_learn=None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the texts and labels of at most sample_rows labelled rows that may be learnt from: those with the least hash of doc_id.

    Rows with null label or doc_id are left out; a doc_id with several labels counts as toxic if one of them is. With
    too few rows of either label the given lexicon is used with fixed weights.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    if may_learn is not None:
        known = known.where(may_learn)
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = texts_of(docs).join(F.broadcast(picked), "doc_id")  # bounded by sample_rows
    sample = stored(rows, "toxicity-sample")
    lexicon = learn_lexicon(sample)

    def run(batches):
        import pyarrow as pa

        words = Lexicon(lexicon)
        for batch in batches:
            made = [features(t or "", words).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in got]).reshape(len(got), FEATURES), np.array([bool(r["toxic"]) for r in got], float)
    if y.sum() < 5 or len(y) - y.sum() < 5:
        return Model(lexicon, np.array([1.0, 0.5, 0.5, -0.2, -0.2, 0.5, 0.5, 0.5, 0.0, -3.0]))
    return Model(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every whole text.

    A null or empty text has no clause and gets the score of such texts, near 0. Repeated rows are each scored; other
    columns are ignored whatever their names; an empty table gives an empty table.
    """
    import pyarrow as pa

    def run(batches):
        words = Lexicon(model.lexicon)
        for batch in batches:
            x = np.array([features(t or "", words) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, predicted int")
