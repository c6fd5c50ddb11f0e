"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

The nodes are a text's tokens with a digit, @ or +. Successive tokens share a potential, and so do a token and the
last one before it that is the same or, digits aside, looks the same, however far away: loopy message passing makes
such tokens' labels agree within a document. The field is trained by pseudo-likelihood on a bounded sample, with the
patterns' spans as labels. Its spans are added where the patterns have none; spans of the patterns always stay.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import chunks, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is none

#: Texts that training takes at most; of these only such with at most so many tokens.
SAMPLE_ROWS, SAMPLE_TOKENS = 2000, 500
#: Marginal probability from which on a token's label adds a span.
CONFIDENCE = 0.9
ROUNDS = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can't begin within digits that didn't match from their first on
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(int) - 48
    twice = d[1::2] * 2
    return int(d[0::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the patterns find, in order."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return sorted(out)


class Graph(NamedTuple):
    """The tokens of some texts: their text's number, place and features, and pairs of tokens that share a potential."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray  # token x slot, an index of a weight
    chain: np.ndarray  # pairs of successive tokens
    skip: np.ndarray  # pairs of equal or like tokens


#: Weights per slot of a token's features.
SLOTS, WIDTH = 14, 16
_TRIM = "\"'()[]{}<>,;:!?.|*="


def _token_features(token: str, before: str, after: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dotted = token.split(".")
    plain = token.replace("-", "")
    out = [
        0,
        min(token.count("@"), 2),
        min(digits, 15) if digits < 14 else 14 + (digits > 19),
        min(letters, 15),
        min(token.count("."), 15),
        min(token.count("-"), 15),
        int("+" in token) + 2 * token.startswith("+"),
        int("(" in token or ")" in token),
        int(len(dotted) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in dotted)),
        int(plain.isdecimal() and plain.isascii() and 14 <= len(plain) <= 19) * (1 + luhn(plain) if plain.isdecimal() and plain.isascii() and 14 <= len(plain) <= 19 else 0),
        int(bool(_DOMAIN.search(token))),
        int(before.startswith("+")) + 2 * before.startswith("("),
        int(after.startswith("(")) + 2 * (sum(c.isdigit() for c in after) >= 7),
        int("=" in token) + 2 * ('"' in token),
    ]
    return [slot * WIDTH + v for slot, v in enumerate(out)]


def graph(texts: list[str]) -> Graph:
    owner, starts, ends, feats, chain, skip = [], [], [], [], [], []
    for t, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hot = np.flatnonzero((points >= 48) & (points < 58) | (points == 64) | (points == 43))
        space = np.concatenate([[-1], np.flatnonzero((points == 32) | (points >= 9) & (points < 14)), [len(points)]])
        words = np.unique(np.searchsorted(space, hot))
        last_same: dict[str, int] = {}
        last_like: dict[str, int] = {}
        tokens = [(int(space[w - 1]) + 1, int(space[w])) for w in words.tolist()]
        raw = [text[a:b] for a, b in tokens]
        for i, ((a, b), word) in enumerate(zip(tokens, raw, strict=True)):
            token = word.strip(_TRIM) or word
            near_before = raw[i - 1] if i and words[i] - words[i - 1] == 1 else ""
            near_after = raw[i + 1] if i + 1 < len(raw) and words[i + 1] - words[i] == 1 else ""
            n = len(owner)
            owner.append(t)
            starts.append(a + len(word) - len(word.lstrip(_TRIM)) if token != word else a)
            ends.append(starts[-1] + len(token))
            feats.append(_token_features(token, near_before, near_after))
            if near_before:
                chain.append((n - 1, n))
            like = _DIGITS.sub(lambda m: str(len(m.group())), token)
            same_at, like_at = last_same.get(token), last_like.get(like)
            if same_at is not None:
                skip.append((same_at, n))
            if like_at is not None and like_at != same_at:
                skip.append((like_at, n))
            last_same[token] = last_like[like] = n
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(owner, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.array(feats, np.int64).reshape(-1, SLOTS), pairs(chain), pairs(skip))


class Field(NamedTuple):
    unary: np.ndarray  # weight of a feature x label
    chain: np.ndarray  # label x label
    skip: np.ndarray


def labels_of(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """For each token the kind of a pattern's span that overlaps it, or 0."""
    out = np.zeros(len(g.text), np.int64)
    by_text: dict[int, list[int]] = {}
    for i, t in enumerate(g.text.tolist()):
        by_text.setdefault(t, []).append(i)
    for t, mine in by_text.items():
        starts, ends = g.start[mine], g.end[mine]
        for a, kind, b in spans[t]:
            for i in range(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)):
                out[mine[i]] = out[mine[i]] or kind + 1
    return out


def fit(g: Graph, y: np.ndarray, steps: int = 150, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """Maximises the likelihood of each token's label given its neighbours', by adaptive gradient steps."""
    f = Field(np.zeros((SLOTS * WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not len(y):
        return f
    seen = [np.zeros_like(w) for w in f]
    a, b = g.chain.T
    c, d = g.skip.T
    for _ in range(steps):
        s = f.unary[g.features].sum(1)
        np.add.at(s, b, f.chain[y[a]])
        np.add.at(s, a, f.chain[:, y[b]].T)
        np.add.at(s, d, f.skip[y[c]])
        np.add.at(s, c, f.skip[:, y[d]].T)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grads = [np.zeros_like(w) for w in f]
        np.add.at(grads[0], g.features, p[:, None, :])
        for k, (x, z) in ((1, (a, b)), (2, (c, d))):
            np.add.at(grads[k], y[x], p[z])
            np.add.at(grads[k].T, y[z], p[x])
        grads[2] = (grads[2] + grads[2].T) / 2  # a link over a distance has no direction
        for w, v, q in zip(f, grads, seen, strict=True):
            v = v / len(y) + penalty * w
            q += v * v
            w -= rate * v / (np.sqrt(q) + 1e-9)
    return f


def marginals(g: Graph, f: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Each token's label probabilities, by message passing over the links of all texts at once."""
    own = f.unary[g.features].sum(1)
    src = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
    dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
    n, m = len(g.chain), len(g.skip)
    table = np.concatenate([np.broadcast_to(w, (k, LABELS, LABELS)) for w, k in ((f.chain, n), (f.chain.T, n), (f.skip, m), (f.skip.T, m))])
    back = np.concatenate([np.arange(n) + n, np.arange(n), np.arange(m) + 2 * n + m, np.arange(m) + 2 * n])
    messages = np.zeros((len(src), LABELS))
    for _ in range(rounds if len(src) else 0):
        belief = own.copy()
        np.add.at(belief, dst, messages)
        x = (belief[src] - messages[back])[:, :, None] + table
        top = x.max(1, keepdims=True)
        new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
        messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
    belief = own.copy()
    np.add.at(belief, dst, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(g: Graph, p: np.ndarray, spans: list[list[tuple[int, int, int]]], confidence: float = CONFIDENCE) -> list[list[tuple[int, int, int]]]:
    """Spans of tokens that the field labels with confidence and no pattern has touched; successive ones with a label are one span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
    if not len(p):
        return out
    free = labels_of(g, spans) == 0
    kind = p.argmax(1)
    good = free & (kind > 0) & (p.max(1) >= confidence)
    linked = {int(b): int(a) for a, b in g.chain}
    last = -2
    for i in np.flatnonzero(good).tolist():
        mine = out[g.text[i]]
        if mine and linked.get(i) == last == i - 1 and kind[i] == kind[last]:
            mine[-1] = (mine[-1][0], mine[-1][1], int(g.end[i]))
        else:
            mine.append((int(g.start[i]), int(kind[i]) - 1, int(g.end[i])))
        last = i
    return out


def _pack(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """A field from at most sample_rows of the texts with a digit or @, those with the least hash of doc_id and length."""
    import pyarrow as pa

    rows = texts_of(docs, F.xxhash64("doc_id", F.length("text")).alias("order")).select("order", "text").where("text rlike '[0-9@]'")
    n = rows.count()
    if n > 2 * sample_rows:
        rows = rows.where(F.col("order") < (4.0 * sample_rows / n - 1) * float(1 << 63))

    def run(batches):
        for batch in batches:
            order, made = [], []
            for o, text in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist(), strict=True):
                g = graph([text])
                if 0 < len(g.text) <= SAMPLE_TOKENS:
                    order.append(o)
                    made.append({"features": g.features.ravel(), "chain": g.chain.ravel(), "skip": g.skip.ravel(), "y": labels_of(g, [base_spans(text)])})
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), *(pa.array([m[c] for m in made], kinds) for c in ("features", "chain", "skip", "y"))], names=["order", "features", "chain", "skip", "y"])

    got = rows.mapInArrow(run, "order long, features array<long>, chain array<long>, skip array<long>, y array<long>").orderBy("order").limit(sample_rows).collect()
    features, chain, skip, y, at = [], [], [], [], 0
    for r in got:
        features.append(np.array(r["features"], np.int64).reshape(-1, SLOTS))
        chain.append(np.array(r["chain"], np.int64).reshape(-1, 2) + at)
        skip.append(np.array(r["skip"], np.int64).reshape(-1, 2) + at)
        y.append(np.array(r["y"], np.int64))
        at += len(r["y"])
    if not got:
        return Field(np.zeros((SLOTS * WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    g = Graph(np.zeros(at, np.int64), np.zeros(at, np.int64), np.zeros(at, np.int64), np.concatenate(features), np.concatenate(chain), np.concatenate(skip))
    return fit(g, np.concatenate(y))


def found_in(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(the patterns' spans, all spans) of each text, in order."""
    base = [base_spans(t) for t in texts]
    g = graph(texts)
    extra = added_spans(g, marginals(g, field), base) if len(g.text) and field.unary.any() else [[] for _ in texts]
    return [(b, sorted(b + e)) for b, e in zip(base, extra, strict=True)]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, spans (all) for every whole text.

    A null text counts as empty and has no spans. Repeated rows are each searched; other columns are ignored whatever
    their names; an empty table gives an empty table. Places are code points, ends exclusive.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        from kerbside.llm.common import by_bytes

        for batch, raw in by_bytes(batches):
            found = found_in([t.decode() for t in raw], field)
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_pack(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([_pack(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return texts_of(docs).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with <kind> for each span; of spans that overlap, one mark for all that they cover."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """docs with all spans in text masked and n_chars, where there is such a column, as it then is. A null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        found = [x for a, b in chunks(whole) for x in found_in(whole[a:b], field)]
        return pd.Series([None if t is None else mask(t, s) for t, (_, s) in zip(texts, found, strict=True)], dtype=object)

    out = docs.withColumn("text", hide(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
