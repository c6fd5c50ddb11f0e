import math

import numpy as np
from kerbside.llm import ann


def table(spark, vectors):
    rows = [(i, v, "x", 1.0) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, score double")


def brute(vectors, every, k):
    good = [(i, np.array(v)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for n, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            near = sorted((-(q * x).sum(), j) for m, (j, x) in enumerate(good) if m != n)
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(24).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[40][1]) for i in range(60)]  # ties
    vectors += [(2000, None), (2020, [0.0] * 24), (2040, [None] + [1.0] * 23), (2060, [math.nan] * 24), (2080, [])]
    df = table(spark, vectors)
    index = ann.build_index(df)
    monkeypatch.setattr(ann, "ROWS", 100)
    rows = ann.nearest(index, index.rows["vec_id"] % 20 == 0, 20, query_bytes=16 * 24 * 8).collect()
    want, got = brute(vectors, 20, 20), {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert hits / (20 * len(want)) >= 0.98
    for q in want:
        if got[q] and {i for i, _ in got[q]} == {i for i, _ in want[q][0]}:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q][0]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q][0]], rtol=1e-12)


def test_few_and_repeated_rows(spark):
    df = table(spark, [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5])])
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect())
    assert rows == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 7, 0.5), (20, 2, 7, 0.5)]
    assert ann.search(table(spark, [])).count() == 0
    assert ann.search(table(spark, [(1, None)])).count() == 0


def test_recall_of_many(spark):
    """20,000 vectors in clumps and at random: recall against all inner products."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 48))
    x[:10_000] += 3 * rng.standard_normal((50, 48))[rng.integers(0, 50, 10_000)]
    x[15_000:] *= rng.uniform(0.1, 4, (5_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == 1000
    hits = 0
    for q, near in found.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(near & set(np.argsort(-scores)[:20].tolist()))
    assert hits / 20_000 >= 0.99


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    turn = ann.rotation(64, 256)
    turned = x / np.linalg.norm(x, axis=1)[:, None] @ turn
    fit = np.abs(turned).sum(1) / 16
    code = np.packbits(turned > 0, axis=1).view(np.uint64)
    queries = ann.rounded(np.arange(20), q, turn)
    off = []
    for i in range(20):
        signs = ann.estimates([np.ascontiguousarray(c) for c in code.T], np.bitwise_count(code).sum(1, dtype=np.int32), queries, i)
        exact = (2.0 * (turned > 0) - 1) @ (q[i] @ turn)
        assert np.abs(signs - exact).max() < 5 * queries.step[i] * np.sqrt(256 / 12)
        length = np.linalg.norm(x, axis=1)
        spread = np.linalg.norm(q[i]) * length * np.sqrt(1 - fit * fit) / fit / np.sqrt(255) + length / fit / 16 * queries.step[i] * np.sqrt(256 / 12)
        off.append((signs * length / fit / 16 - x @ q[i]) / spread)
    off = np.concatenate(off)
    assert (np.abs(off) < ann.EPSILON).mean() > 0.98 and abs(off.mean()) < 0.05
