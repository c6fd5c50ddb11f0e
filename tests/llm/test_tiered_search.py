import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from kerbside.llm import queries as Q
from kerbside.llm import tiered_search as T

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score), document after document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for at, (d, c) in enumerate(counts):
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0, at))
        out += [(item, r, d if some else None, -s) for r, (s, some, d, _) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "naïve", "A1"]
    draw = lambda m: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=m))
    docs = [(rng.randrange(10**6), draw(rng.choice([0, 1, 3, 20, 60]))) for _ in range(n)]
    docs += [(None, draw(9)), (None, None), (7, None), (8, ""), (9, "-- !!"), (10, "w59 " * 3000)] + docs[:30]
    items = [(i, draw(rng.choice([1, 4, 12]))) for i in range(25)] + [(90, None), (91, ""), (92, "unheardof"), (3, "w59 w58"), (3, "w59 w58"), (93, "w0-W0,w1")]
    return docs, items


@pytest.mark.parametrize(("seed", "tiers"), [(0, T.TIERS), (1, ((3, 0.0), (20, 0.1))), (2, ((40, 0.3),)), (3, ())])
def test_as_document_after_document(spark, monkeypatch, seed, tiers):
    monkeypatch.setattr(T, "MATRIX", 700)
    monkeypatch.setattr(T, "BLOCK_ITEMS", 13)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rid int, terms string").repartition(3)
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    got = T.search(d, i, 10, tiers).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter(ranked(docs, items, 10))
    if seed == 0:
        assert {r.tier for r in got} == {1}  # so few postings are all in the first tier, with nothing left over
    elif tiers:
        assert len({r.tier for r in got}) > 1


def test_no_documents_and_no_items(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert T.search(docs, items).count() == 0 and T.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 5)
    text = "Some-text wïth, several terms ofdifferentlength x".encode()
    assert [w.decode() for words in T.terms_of(text) for w in words] == terms(text.decode())


def test_bounds_hold(spark):
    docs, _ = corpus(5)
    names = sorted({t.encode() for _, x in docs for t in terms(x)})
    index = T.build_index(spark.createDataFrame(docs, "doc_id long, text string"), names, ((5, 0.0), (40, 0.2)))
    everything = {}
    for r in index.rows.collect():
        impact = T.impacts(np.array(r.tfs), np.full(len(r.tfs), r.n), index.n_docs, index.length)
        everything[r.rid] = dict(zip(r.terms, impact.tolist(), strict=True))
    for tier, bound in zip(index.tiers, index.bounds, strict=True):
        there = {(r.rid, t): i for r in tier.collect() for t, i in zip(r.terms, r.impacts, strict=True)}
        assert there and all(everything[d][t] == i for (d, t), i in there.items())
        for d, own in everything.items():
            for t, i in own.items():
                assert (d, t) in there or i <= bound[t]


def test_query_and_sql(spark, tmp_path):
    docs, items = corpus(4)
    docs = list({d: (d, t) for d, t in docs if d is not None}.values())
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items = list(dict(items).items())
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(ranked(docs, items, 50))
    assert sorted(con.sql(Q.oracle_sql()["op11_tiered_search"]).fetchall()) == want
    assert sorted(map(tuple, Q.op11_tiered_search(spark, str(tmp_path)).collect())) == want
