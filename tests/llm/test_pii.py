import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from kerbside.llm import pii


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and plain_luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@given(st.text("1234567890+@.-() abé%_", max_size=120))
@settings(max_examples=600, deadline=None)
def test_patterns_against_brute_force(text):
    assert pii.base_spans(text) == brute(text)


@given(st.lists(st.sampled_from(["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-0199", "300.1.1.1", "01.002.3.255", "x", "@", "4111111111111111", "5.6", ".", "+12", "é"]), max_size=12), st.sampled_from(["", " ", "."]))
@settings(max_examples=300, deadline=None)
def test_patterns_side_by_side(parts, between):
    assert pii.base_spans(between.join(parts)) == brute(between.join(parts))


def test_long_runs_end():
    for text in ("1" * 200000, "a" * 200000 + "@", "@" + "a" * 200000, "1." * 100000, "+1" + " " * 200000):
        pii.base_spans(text)


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(1)
    g = pii.Graph(*(np.zeros(4, np.int64) for _ in range(3)), np.arange(4)[:, None] * np.ones((1, pii.SLOTS), np.int64), np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))
    f = pii.Field(rng.standard_normal((pii.SLOTS * pii.WIDTH, 5)) / 5, rng.standard_normal((5, 5)), (lambda w: w + w.T)(rng.standard_normal((5, 5))))
    own, p = f.unary[g.features].sum(1), np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(own[i, y[i]] for i in range(4)) + f.chain[y[0], y[1]] + f.chain[y[1], y[2]] + f.skip[y[0], y[3]])
        for i in range(4):
            p[i, y[i]] += w
    assert np.allclose(pii.marginals(g, f, 60), p / p.sum(1, keepdims=True), atol=1e-6)


def test_repeated_tokens_agree():
    f = pii.Field(np.zeros((pii.SLOTS * pii.WIDTH, 5)), np.zeros((5, 5)), 4 * np.eye(5))
    g = pii.graph(["n77 then more n77 and n77"])
    assert len(g.skip) == 2
    f.unary[g.features[0]] = 0
    unary = f.unary.copy()
    p = pii.marginals(g, f._replace(unary=unary))
    assert np.allclose(p[0], p[2])


def corpus(n=300):
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choice(["tion", "re", "the", "onha", "éa", "12", "x7"]) for _ in range(k))
    make = [lambda: f"u{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: str(rng.randint(10**15, 10**16 - 1))]
    return [" ".join(f"{say(9)} {rng.choice(make)()}" for _ in range(3)) + " " + say(5) for _ in range(n)]


def test_query_against_brute_force(spark, odd_docs, no_docs):
    texts = corpus()
    docs = spark.createDataFrame([(i + 1000, t, "s", 2) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip long").unionByName(odd_docs.select("doc_id", "text"), allowMissingColumns=True)
    field = pii.train(docs)
    rows = pii.find(docs, field).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(pii._pack(brute(r.text or "")).encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 1000:
            base = pii._pack(brute(texts[r.doc_id - 1000])).split(",") if brute(texts[r.doc_id - 1000]) else []
            assert set(base) <= set(r.spans.split(","))
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
    extra = sum(len(r.spans.split(",")) - (r.n_email + r.n_ip + r.n_card + r.n_phone) for r in rows if r.spans)
    assert extra < 30
    assert pii.find(no_docs, field).count() == 0 and pii.train(no_docs).unary.any() == False  # noqa: E712
    hidden = {r.doc_id: r.text for r in pii.masked(docs, field).collect()}
    assert hidden[1000].count("<") >= len(brute(texts[0])) - 1 and not brute(hidden[1000])
