import random
import re
from collections import defaultdict

import numpy as np
import pytest
from kerbside.llm import jaccard_join as J
from kerbside.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeFGé") for _ in range(rng.randint(1, 6)))
    line = " ".join(word() for _ in range(12))
    out = [None, "", " \n", "One", "one", "two words", "Two Words", line, line + " x", line + " x y z"]
    for _ in range(n):
        base = [word() for _ in range(int(rng.choice([6, 12, 30, 60, 120, 400])))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = word()
            cut = rng.randint(0, len(other) // 6)
            out.append(" ".join(other[cut:]) + (" " + line if rng.random() < 0.2 else ""))
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, options", [(1, J.Options()), (2, J.Options(costly=2)), (3, J.Options(spread=0.3)), (4, J.Options(spread=0.7, thick=4))])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed) + [(5000, corpus(seed)[20][1]), (None, corpus(seed)[20][1]), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, key string").repartition(3)
    got = J.similar_groups(df, options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(a), b, str(c)) for a, b, c in brute(rows))


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(5)
    for options in ({"spread": 1.5, "thick": 32}, {"spread": 0.25, "thick": 4}):
        short = set()
        for _ in range(300):
            n = int(rng.integers(4, 300))
            r = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = int(rng.integers(0, len(r) // 4 + 1))
            keep = rng.permutation(r)[gone:]
            new = int(rng.integers(0, len(keep) // 3 + 1))
            s = np.unique(np.concatenate([keep, rng.integers(0, 2**63, new).astype(np.uint64)]))
            both = len(np.intersect1d(r, s))
            if 100 * both < 75 * (len(r) + len(s) - both):
                continue
            sets, met = (r, s), False
            for band in set(J.bands_of(len(r))) & set(J.bands_of(len(s))):
                hows = [J.shortage(x, band, 75, **options) or (0, 0) for x in sets]
                how = max(h[0] for h in hows), max(h[1] for h in hows)
                short.add(how)
                taken = []
                for x in sets:  # any order of all keys will do
                    keys, need = J.indexed(x, band, how, 75, **options)
                    taken.append(set(sorted(keys.tolist(), key=lambda k: k * 0x9E3779B1 % 1000003)[: max(0, need + len(keys))]))
                met |= bool(set.intersection(*taken))
            assert met
    assert (0, 1) in short  # deletions were tried


def test_sketches_never_exclude_a_similar_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 260).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(40, 260))], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(80)]
    sizes, bits = np.array([len(s) for s in sets]), [J.sketch(s) for s in sets]
    found = set(zip(*(x.tolist() for x in J.close_pairs([sizes, sizes], [bits, bits], 75))))
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if 100 * (n := len(np.intersect1d(s, t))) >= 75 * (len(s) + len(t) - n)}
    assert want <= found and len(found) < 2 * len(want) + 20


def test_chains_through_members_that_are_not_the_least(spark):
    """Each text links with its neighbours only, and all share a passage that is in nobody's way."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 100])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.component_id) for r in J.similar_groups(df).collect()} == {(d, c) for d, _, c in brute(rows)}


def test_nothing(no_docs, spark):
    assert J.similar_groups(no_docs).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 300: 200}


def test_links_within_a_component(spark, no_docs):
    rows = [(d, t) for d, t in corpus(1) if t] + [(5000, corpus(1)[20][1])]
    base = [f"w{i}" for i in range(80)]
    rows += [(6000 + i, " ".join(base[: 80 - i])) for i in range(12)]  # a list in which all link with each other, or nearly
    of = {}
    for d, t in rows:
        if s := shingles(t):
            of[frozenset(s)] = min(d, of.get(frozenset(s), d))
    sets = list(of)
    want = {tuple(sorted((of[s], of[t]))) for i, s in enumerate(sets) for t in sets[:i] if 100 * len(s & t) >= 75 * len(s | t)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in (J.Options(), J.Options(costly=2)):
        got = [tuple(sorted((r.doc_a, r.doc_b))) for r in J.similar_links(df, options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(a >= 6000 and b >= 6000 for a, b in want) > 40
    assert J.similar_links(no_docs).count() == 0
