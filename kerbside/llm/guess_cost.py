"""Secrets in texts: patterns, and values in credential context that would take many guesses.

A value is cut into words, dates, repeats, keyboard walks, alphabet or number runs and single characters, so that the
guesses of all parts together are as few as they can be. The cut is found by dynamic programming from left to right;
costs are in bits (binary logarithms of guesses), so that parts add up. Words are those of the corpus, ranked by how
often it has them: a guesser would try the commonest first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import by_bytes, stored, texts_of

#: Bits from which a value is a secret: 10 ** 10 guesses, out of reach of a throttled or slowly hashed attack.
SECRET_BITS = math.log2(1e10)
#: Words that the dictionary holds, the commonest of the corpus, and their lengths in bytes.
DICTIONARY, SHORTEST_WORD, LONGEST_WORD = 20_000, 3, 24
#: Different words that a task counts before it gives its counts out.
COUNTED = 200_000
#: Letters of a value in credential context at least.
LEAST_VALUE = 6

KINDS = ("assign", "access", "hex", "value")

# The base patterns, where letters of keywords may have either case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Words that say that what follows is a credential, what may stand between, and the value.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[ _-]?key|auth(?:orization)?|bearer|login|pin)(?![A-Za-z])"""
    r"""["'`\])]?[\x20\t]{0,8}(?:(?:is|was|=>|->|:=|[:=])[\x20\t]{0,8}){0,2}["'`(<\[]?([^\s"'`<>()\[\]{},;]+)""",
    re.IGNORECASE | re.ASCII,
)
#: What a text with anything to find holds in lower case.
_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "login", "pin")

# Rows of a keyboard and of a number pad, and letters that other characters stand for.
KEYBOARD = ("`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./")
KEYPAD = ("\t/*-", "789+", "456", "123", "\t0.")
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))


def _neighbours(rows: tuple[str, ...], slanted: bool) -> dict[str, frozenset[str]]:
    """Which keys touch which: beside each other, and above and below (two each where rows are slanted, else three)."""
    place = {k: (x, y) for y, row in enumerate(rows) for x, k in enumerate(row) if k != "\t"}
    near = [(-1, 0), (1, 0), (0, -1), (1, -1), (-1, 1), (0, 1)] + ([] if slanted else [(-1, -1), (1, 1)])
    at = {v: k for k, v in place.items()}
    return {k: frozenset(at[(x + dx, y + dy)] for dx, dy in near if (x + dx, y + dy) in at) for k, (x, y) in place.items()}


_TOUCH = [_neighbours(KEYBOARD, True), _neighbours(KEYPAD, False)]
_START = [math.log2(len(t)) for t in _TOUCH]
_TURN = [math.log2(sum(map(len, t.values())) / len(t)) for t in _TOUCH]

#: A part costs this besides its own guesses: a guesser has to try the kinds of parts, too.
_PART = 1.0
_DIGIT, _LETTER, _MARK, _OTHER = math.log2(10), math.log2(26), math.log2(33), math.log2(1000)
_DATE = re.compile(r"(\d{1,4})([-/._]?)(\d{1,2})\2(\d{1,4})")
#: The year that guesses begin with, and how many years on either side are tried at least.
_YEAR, _YEARS = 2020, 20


def _character(c: str) -> float:
    if c.isascii():
        return _DIGIT if c.isdigit() else _LETTER if c.isalpha() else _MARK
    return _OTHER


def _cased(word: str) -> float:
    """Bits for which letters are capitals."""
    upper, letters = sum(c.isupper() for c in word), sum(c.isalpha() for c in word)
    if not upper:
        return 0.0
    if upper == letters or upper == 1 and (word[0].isupper() or word[-1].isupper()):
        return 1.0
    return math.log2(sum(math.comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)))


def _date(text: str) -> float | None:
    """Bits of a date with or without separators, or None."""
    m = _DATE.fullmatch(text)
    if not m:
        return None
    found = None
    whole = re.sub(r"\D", "", text)
    splits = [(m[1], m[3], m[4])] if m[2] else [(whole[:a], whole[a:b], whole[b:]) for a in (1, 2, 4) for b in (a + 1, a + 2) if b < len(whole)]
    for a, b, c in splits:
        for d, mo, y in ((a, b, c), (b, a, c), (c, b, a)):
            if len(d) > 2 or len(mo) > 2 or len(y) not in (2, 4) or not (1 <= int(d) <= 31 and 1 <= int(mo) <= 12):
                continue
            year = int(y) if len(y) == 4 else int(y) + (2000 if int(y) <= (_YEAR + 10) % 100 else 1900)
            if 1000 <= year <= 2100:
                bits = math.log2(365 * max(abs(year - _YEAR), _YEARS)) + (2 if m[2] else 0)
                found = bits if found is None else min(found, bits)
    return found


def _walks(value: str) -> list[tuple[int, int, float]]:
    """(start, end, bits) of runs of three or more keys that touch, alphabet and number runs, for each of their beginnings."""
    keys = "".join(SHIFTED.get(c, c.lower()) for c in value)
    out, n = [], len(value)
    for touch, first, turn in zip(_TOUCH, _START, _TURN, strict=True):
        i = 0
        while i < n - 2:
            j, turns, last = i, 0, None
            while j + 1 < n and keys[j + 1] in touch.get(keys[j], ()):
                # the direction is told by the pair of keys: a straight row goes on with the same step of code or place
                step = _step(touch, keys[j], keys[j + 1])
                turns += step != last
                last = step
                j += 1
                if j - i >= 2:
                    shifts = sum(a != b for a, b in zip(value[i : j + 1], keys[i : j + 1], strict=True))
                    out.append((i, j + 1, first + turns * turn + math.log2(j - i + 1) + (math.log2(math.comb(j - i + 1, min(shifts, (j - i + 1) // 2)) + 1) if shifts else 0)))
            i = max(i + 1, j - 1) if j - i >= 2 else i + 1
    i = 0
    while i < n - 2:
        step = ord(value[i + 1]) - ord(value[i])
        j = i + 1
        if abs(step) in (1, 2) and value[i].isascii():
            while j + 1 < n and ord(value[j + 1]) - ord(value[j]) == step:
                j += 1
                base = math.log2(4) if value[i] in "aAzZ019" else _character(value[i])
                out.append((i, j + 1, base + (1 if step < 0 else 0) + (1 if abs(step) > 1 else 0) + math.log2(j - i + 1)))
        i = max(i + 1, j)
    return out


def _step(touch, a: str, b: str) -> int:
    for rows in (KEYBOARD, KEYPAD):
        place = _PLACES[rows]
        if a in place and b in place and b in touch.get(a, ()):
            (x, y), (u, v) = place[a], place[b]
            return (u - x) * 10 + (v - y)
    return 0


_PLACES = {rows: {k: (x, y) for y, row in enumerate(rows) for x, k in enumerate(row) if k != "\t"} for rows in (KEYBOARD, KEYPAD)}


def _repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches in which pieces of 1 to LONGEST_WORD characters follow themselves, the longest of each period."""
    out = []
    for p in range(1, min(LONGEST_WORD, len(value) // 2) + 1):
        run = 0
        for i in range(p, len(value) + 1):
            if i < len(value) and value[i] == value[i - p]:
                run += 1
            else:
                if run >= max(p, 2):
                    a = i - run - p
                    out.append((a, a + (run + p) // p * p, p))
                run = 0
    return out


def guess_bits(value: str, ranks: Mapping[str, int]) -> float:
    """The binary logarithm of the guesses that the cheapest cut of value takes; 0 for nothing.

    ranks: words in lower case, and their places in the dictionary from 1. Time grows with the length of value.
    """
    n = len(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    lower = value.lower()
    if len(lower) != n:  # some capitals have longer small letters
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = "".join(LEET.get(c, c) for c in lower)
    swaps = [0]
    for a, b in zip(lower, plain, strict=True):
        swaps.append(swaps[-1] + (a != b))
    for i in range(n):
        for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
            for word, extra in ((lower[i:j], 0.0), (lower[i:j][::-1], 1.0)):
                if (rank := ranks.get(word)) is not None:
                    ends[j].append((i, math.log2(rank + 1) + _cased(value[i:j]) + extra))
            if (k := swaps[j] - swaps[i]) and (rank := ranks.get(plain[i:j])) is not None:
                ends[j].append((i, math.log2(rank + 1) + _cased(value[i:j]) + k))
    for m in re.finditer(r"(?=([\d./_-]{4,10}))", value):
        for j in range(4, len(m[1]) + 1):
            if (bits := _date(m[1][:j])) is not None:
                ends[m.start() + j].append((m.start(), bits))
    for a, b, bits in _walks(value):
        ends[b].append((a, bits))
    for a, b, p in _repeats(value):  # what the piece takes alone, and how often it's there
        ends[b].append((a, guess_bits(value[a : a + p], ranks) + math.log2((b - a) // p)))
    best = [0.0] + [math.inf] * n
    # a stretch of characters tried one by one is one part, however long
    single = [math.inf] * (n + 1)
    for j in range(1, n + 1):
        c = _character(value[j - 1])
        single[j] = min(single[j - 1] + c, best[j - 1] + c + _PART)
        best[j] = min(best[j], single[j], *(best[i] + bits + _PART for i, bits in ends[j]))
    return best[n]


def common_words(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """word, n, of the size commonest words of all texts in lower case: runs of letters of 3 to 24 bytes.

    Equal counts go by the word. Tasks count the words of their texts before anything is shuffled.
    """
    import pyarrow as pa

    # bytes over 127 are parts of letters, mostly; capitals of A to Z become small, all else parts words
    table = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

    def give(counts):
        some = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in some]), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for _, texts in by_bytes(batches):
            counts.update(b" ".join(texts).translate(table).split())
            if len(counts) > COUNTED:
                yield give(counts)
                counts = Counter()
        if counts:
            yield give(counts)

    # the dictionary is as large as it is said to be, whatever the corpus holds
    words = texts_of(docs).select("text").mapInArrow(run, "word string, n long").where(F.octet_length("word").between(SHORTEST_WORD, LONGEST_WORD))
    return words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The ranks, from 1, of common_words()."""
    rows = stored(common_words(docs, size), "words").collect()
    return {r.word: i for i, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.word.encode())), 1)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of what the patterns find."""
    out = []
    if any(w in (low := text.lower()) for w in ("passw", "secret", "token", "api")):
        del low
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands where a credential would: after a word for one, without the marks that end a sentence.

    Values of letters alone, with no capitals but the first, are words of prose: "the secret is honesty".
    """
    low = text.lower()
    if not any(w in low for w in _HINTS):
        return []
    out, at = [], 0
    while m := _CONTEXT.search(text, at):
        value = m[1].rstrip(".:!?*_~")
        if len(value) >= LEAST_VALUE and not (value.isalpha() and value[1:] == value[1:].lower()):
            out.append((m.start(1), m.start(1) + len(value)))
        at = max(m.start(1), m.start() + 1)  # the value may itself be a word for a credential
    return out


SPANS = "doc_id long, kind string, start long, end long, value string, bits double"


def _found(text: str, ranks: Mapping[str, int], least: float) -> list[tuple[int, int, int, str, float | None]]:
    """All spans by start, then kind; those of values have what they cost."""
    base = base_spans(text)
    out = [(a, k, b, text[a:b], None) for a, k, b in base]
    taken = [(a, b) for a, _, b in base]
    for a, b in dict.fromkeys(values(text)):
        if any(a < y and x < b for x, y in taken):
            continue
        bits = guess_bits(text[a:b], ranks)
        if bits >= least:
            out.append((a, 3, b, text[a:b], bits))
            taken.append((a, b))
    return sorted(out, key=lambda x: x[:3])


def find(docs: DataFrame, ranks: Mapping[str, int], least: float = SECRET_BITS) -> DataFrame:
    """A row per secret: doc_id, kind (assign, access, hex or value), start, end (code points, end exclusive), value, and bits of a value in context.

    A null text is empty. A text of any length is searched whole, and a row repeats as often as docs has it. The base
    patterns' spans always stay; a value in context is told only where none of them stands.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(dict(ranks))

    def run(batches):
        for batch, texts in by_bytes(batches):
            rows = [(d, KINDS[k], a, b, v, bits) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for a, k, b, v, bits in _found(t.decode("utf-8", "replace"), sent.value, least)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "kind", "start", "end", "value", "bits"])

    return texts_of(docs).mapInArrow(run, SPANS)


DIGESTS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_values long, max_bits double"


def digests(docs: DataFrame, ranks: Mapping[str, int], least: float = SECRET_BITS) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256, spans, and count and largest cost of the values in context.

    A null or empty text has no spans. Columns of docs other than doc_id and text are ignored. No row without documents.
    """
    import hashlib

    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(dict(ranks))

    def say(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)

    def run(batches):
        for batch, texts in by_bytes(batches):
            out = []
            for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                spans = _found(t.decode("utf-8", "replace"), sent.value, least)
                base = [s for s in spans if s[1] < 3]
                count = Counter(k for _, k, *_ in spans)
                out.append((d, count[0], count[1], count[2], hashlib.sha256(say(base).encode()).hexdigest(), say(spans), count[3], max((s[4] for s in spans if s[4] is not None), default=None)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return texts_of(docs).mapInArrow(run, DIGESTS)
