import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from kerbside.llm import substring_dedup as S
from kerbside.llm.common import word_hashes


def brute(rows, window):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice(["", "é", "xy"]) for _ in range(n)]
    passages = [say(rng.randint(20, 80)) for _ in range(6)]
    rows = []
    for i in range(70):
        words = say(rng.randint(0, 90))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(passages[: 1 + i % 6])
            a = rng.randint(0, len(p) // 3)
            at = rng.randint(0, len(words))
            words[at:at] = p[a : len(p) - rng.randint(0, 5)]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words)))
    return rows + [(500, rows[3][1]), (500, rows[3][1]), (501, " ".join(["tick"] * 200)), (502, None), (503, ""), (None, rows[4][1]), (504, " ".join(say(34))), (505, "z" * 9000)]


@pytest.mark.parametrize("seed, window, k, held", [(1, 35, 16, 2_000_000), (2, 35, 16, 50), (3, 10, 4, 300)])
def test_against_brute_force(spark, monkeypatch, seed, window, k, held):
    monkeypatch.setattr(S, "HELD", held)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, [2]) for d, t in rows], "doc_id long, text string, rid long, places array<int>").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df, window, k).collect())
    assert got == brute(rows, window)


def test_anchors_are_of_their_windows():
    words, lens = word_hashes([b" ".join(b"%d" % (i * i % 37) for i in range(n)) for n in (60, 3, 0, 35, 120)])
    start, at, grams = S.anchors(words, lens)
    assert len(start) == 26 + 1 + 86
    for i, j in zip(start, at):
        mine = grams[i : i + 20]
        assert j == i + max(np.flatnonzero(mine == mine.min()))


def test_nothing(no_docs):
    assert S.remove_repeats(no_docs).count() == 0
