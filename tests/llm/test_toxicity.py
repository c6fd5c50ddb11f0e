import random

import numpy as np
from kerbside.llm import toxicity as T
from pyspark.sql import functions as F


def test_clauses_are_scored_not_words():
    lexicon = T.Lexicon({})
    plain = T.features("You are an idiot.", lexicon)
    assert plain[0] > 0 and plain[2] > 0
    negated = T.features("You are not an idiot.", lexicon)
    assert negated[0] == 0 and negated[3] > 0
    reported = T.features("She said that they are idiots.", lexicon)
    assert reported[0] == 0 and reported[4] > 0
    assert T.features("I will kill you.", lexicon)[5] > 0
    assert T.features("They kill time.", lexicon)[5] == 0  # no intent
    assert T.features("Not here. You idiot!", lexicon)[0] > 0  # a negation ends with its clause
    assert not T.features("", lexicon).any()


def one_after_the_other(symbols):
    """(marks, weight) of the hits: each machine reads all that the one before it has written."""
    lines = [(s, 1.0) for s in symbols]
    for m in T._transducers():
        state, written = 0, []
        for symbol, weight in lines:
            state, out, w = m.step(state, symbol)
            written.append((out, weight * w))
        lines = written
    return lines


def plainly(symbols):
    """What each hit comes to, told by rules instead of machines."""
    out, intent, quoted, report, spoken = [], False, False, False, False
    target = T.TARGET in symbols
    for i, s in enumerate(symbols):
        marks, weight = 0, 1.0
        threatened = s == T.THREAT and intent
        if threatened or s == T.INSULT:
            marks = T.THREATENED if threatened else 0
            weight = T.PILED if s == T.INSULT and i and symbols[i - 1] == T.INSULT else 1.0
            near = [k for k in range(1, T.NEGATION_REACH + 1) if k <= i and symbols[i - k] == T.NEGATION]
            if near:
                marks, weight = marks | T.NEGATED, weight * T.NEGATED_WEIGHT[near[0] - 1]
            if report or spoken:
                marks, weight = marks | T.REPORTED, weight * T.REPORTED_WEIGHT
            if target:
                marks, weight = marks | T.TARGETED, weight * T.TARGET_WEIGHT
            out.append((marks, weight))
        intent = s == T.INTENT or intent and s not in (T.THREAT, T.QUOTE)
        if s == T.REPORT:
            report, spoken = report or not quoted, spoken or quoted
        if s == T.QUOTE:
            report, spoken, quoted = report or spoken, False, not quoted
    return out


def test_the_cascade_is_its_machines_in_turn_and_the_rules():
    rng = random.Random(2)
    assert T.hits_of([(T.NEGATION, 0), (T.OTHER, 0), (T.INSULT, 2.0), (T.TARGET, 0)]) == [(T.NEGATED | T.TARGETED, 2.0 * T.NEGATED_WEIGHT[1] * T.TARGET_WEIGHT)]
    for _ in range(3000):
        symbols = [rng.randrange(8) for _ in range(rng.randrange(14))]
        got = T.hits_of([(s, 1.0) for s in symbols])
        want = plainly(symbols)
        assert [m for m, _ in got] == [m for m, _ in want] and np.allclose([w for _, w in got], [w for _, w in want]), symbols
        written, state = one_after_the_other(symbols), 0
        for symbol, (out, weight) in zip(symbols, written, strict=True):
            state, o, w = T.GRAMMAR[state, symbol]
            assert o == out and abs(w - weight) < 1e-12


def data(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice(["an", "er", "ti", "ou", "sh"]) for _ in range(3)) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = say(40) + (f" zorkon {say(3)} zorkish you. grum {say(5)}" if toxic else "")
        rows.append((i, text, "en", 0.1, 3))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, odd_docs, no_docs):
    docs, labels = data(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = T.train(docs, labels, ~held)
    rows = T.score(docs, model).join(labels, "doc_id").withColumn("held", held).collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    odd = T.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and not any(r.predicted for r in odd)
    assert T.score(no_docs, model).count() == 0
    empty = T.train(no_docs, labels.limit(0))
    assert T.score(odd_docs, empty).count() == odd_docs.count()


def test_lexicon_does_not_depend_on_partitions(spark):
    """A word of all texts is no sign of toxic ones, however these are laid out."""
    rows = [(f"common zorkon{i % 3} only" if i < 40 else f"common quiet{i % 5}", int(i < 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, toxic int").coalesce(1)
    one = T.learn_lexicon(df)
    parts = [df.where("toxic = 1"), df.where("toxic = 0")]
    assert T.learn_lexicon(parts[0].unionByName(parts[1])) == one and T.learn_lexicon(df.repartition(8)) == one
    assert "zorkon1" in one and "common" not in one
