import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kerbside.llm import guess_cost as G

RANKS = {w: i for i, w in enumerate("the and password manager monkey dragon abc one love".split(), 1)}


def cheapest(value):
    """All cuts, one after the other."""
    parts = {(i, j): math.inf for i in range(len(value)) for j in range(i + 1, len(value) + 1)}
    for i, j in parts:
        piece, low = value[i:j], value[i:j].lower()
        found = [sum(map(G._character, piece))]
        leet = "".join(G.LEET.get(c, c) for c in low)
        if len(piece) >= 3:
            if low in RANKS:
                found.append(math.log2(RANKS[low] + 1) + G._cased(piece))
            if low[::-1] in RANKS:
                found.append(math.log2(RANKS[low[::-1]] + 1) + G._cased(piece) + 1)
            if leet != low and leet in RANKS:
                found.append(math.log2(RANKS[leet] + 1) + G._cased(piece) + sum(a != b for a, b in zip(low, leet, strict=True)))
        if 4 <= len(piece) <= 10 and (bits := G._date(piece)) is not None:
            found.append(bits)
        parts[i, j] = min(found)
    for i, j, bits in G._walks(value):
        parts[i, j] = min(parts[i, j], bits)
    for i, j, p in G._repeats(value):
        parts[i, j] = min(parts[i, j], cheapest(value[i : i + p]) + math.log2((j - i) // p))

    def cut(i):
        return 0.0 if i == len(value) else min(parts[i, j] + G._PART + cut(j) for j in range(i + 1, len(value) + 1))

    return cut(0)


@given(st.lists(st.sampled_from(["abc", "A", "love", "3v0l", "p@ss", "1987", "12", "-", "x", "qwe", "rty", "é", "Mon", "key"]), max_size=4).map("".join).filter(lambda s: len(s) <= 11))
@settings(max_examples=150, deadline=None)
def test_the_cheapest_cut_of_all(value):
    assert math.isclose(G.guess_bits(value, RANKS), cheapest(value), abs_tol=1e-9)


def test_what_takes_few_guesses_and_what_many():
    few = ["password", "P@ssw0rd", "drowssap", "monkeydragon", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabc", "qwertyuiop", "zaq12wsx", "87654321", "12/05/1987", "19870512", "password1987"]
    many = ["x7Gq2LpV9zRt", "04dbebab91ab85687d33eeaa", "vB3!kd92Lm_qe"]
    assert all(G.guess_bits(v, RANKS) < G.SECRET_BITS for v in few) and all(G.guess_bits(v, RANKS) > G.SECRET_BITS for v in many)
    assert G.guess_bits("", RANKS) == 0 and G.guess_bits("x" * 20000, RANKS) < 30  # long ones take no longer than their length
    assert G.guess_bits("x7Gq", RANKS) < G.guess_bits("x7Gq2", RANKS)


def test_dates():
    assert G._date("12/05/1987") and G._date("1987-05-12") and G._date("120587") and G._date("19870512")
    assert G._date("99/99/9999") is None and G._date("12/05-1987") is None and G._date("0000") is None


def plain(text):
    """The base spans by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


BITS = ["password", "Token", "API_KEY", "apikey", "secret", " = ", ": ", '"', "'", "abcdefgh", "short", "AKIA", "IOSFODNN7EXAMPLE", "0123456789abcdef" * 2, "f", " ", "é", "K", "toKen", "ſecret", "=", "\n"]


@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert G.base_spans(text) == plain(text)


def test_values_in_context():
    found = lambda t: [t[a:b] for a, b in G.values(t)]
    assert found("The password is x7Gq2LpV9zRt.") == ["x7Gq2LpV9zRt"]
    assert found("Authorization: Bearer abc.def-123!") == ["Bearer"][:0] + ["abc.def-123"]
    assert found("a password manager; the secret is honesty; keypad 4 login") == []
    assert found("pwd -> 'tr0ub4dor&3'") == ["tr0ub4dor&3"] and found("pin:12345") == []


def test_digests(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(900, "pwd: x7Gq2LpV9zRt and token = abcdefgh99", None, None, 1, "x", "y"), (901, "pwd: password1", None, None, 1, "x", "y")], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    ranks = G.dictionary(docs) | {"password": 1}
    got = G.digests(docs, ranks).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        base = plain(texts[r.doc_id])
        want = ",".join(f"{G.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert by[900].spans == "value:5:17,assign:22:40" and by[900].max_bits > G.SECRET_BITS and by[901].spans == "" and by[901].n_values == 0
    assert {(r.kind, r.start, r.end, r.value) for r in G.find(docs, ranks).where("doc_id = 900").collect()} == {("value", 5, 17, "x7Gq2LpV9zRt"), ("assign", 22, 40, "token = abcdefgh99")}
    assert G.digests(no_docs, G.dictionary(no_docs)).count() == 0


def test_the_dictionary_counts_all_texts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(G, "COUNTED", 10)
    got = {r.word: r.n for r in G.common_words(odd_docs).collect()}
    want = {}
    for r in odd_docs.collect():
        for w in re.split(r"[^a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            if 3 <= len(w.encode()) <= 24:
                want[w] = want.get(w, 0) + 1
    assert got == want
    ranks = G.dictionary(odd_docs, 5)
    assert sorted(ranks.values()) == [1, 2, 3, 4, 5] and min(want[w] for w in ranks) >= sorted(want.values())[-5]


@pytest.mark.parametrize("word", ["Love", "LOVE", "lovE", "lOvE"])
def test_capitals_cost(word):
    assert G.guess_bits(word, RANKS) > G.guess_bits("love", RANKS)
