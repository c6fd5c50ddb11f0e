import random

import numpy as np
from kerbside.llm import language_id as L
from pyspark.sql import functions as F


def docs(spark, n=120):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["keit", "sch", "ung", "ß"], "cc": ["eau", "é", "ment", "que"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang, 0.5, "n"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")


def test_held_out_accuracy(spark):
    df = docs(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = L.train(df, ~held)
    rows = L.predict(df, model).join(df.select("doc_id", "lang", held.alias("held")), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_odd_rows(spark, odd_docs, no_docs):
    model = L.train(docs(spark))
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) or r.doc_id is None
    assert L.predict(no_docs, model).count() == 0
    assert L.train(no_docs) is None
    assert {r.lang_pred for r in L.predict(odd_docs, None).collect()} == {"und"}


def test_batches_do_not_change_ngrams():
    texts = [b"abc def", b"", "é1 ü".encode(), b"12", b"x"]
    grams, lens, has = L.ngrams(texts)
    parts = np.split(grams, np.cumsum(lens)[:-1])
    assert has.tolist() == [True, False, True, False, True]
    for t, p in zip(texts, parts):
        alone, n, _ = L.ngrams([t])
        assert n[0] == len(p) and sorted(alone[:-2]) == sorted(p[:-2])
