"""The tokenizers library with a bounded table of what whole words encode to, kept by each Python worker.

A text is cut where white space follows something else, and where a mark follows a letter. No match of either
tokenizer's split pattern goes over such a place, so a text's ids are those of its pieces. Texts with white space
other than ASCII, which the patterns treat differently, and texts with something like a special token, which the
library looks for first, are encoded whole. All pieces of many texts are cut and looked up at once; the library
encodes those that aren't in the table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np

from kerbside.llm.common import REMEMBERED, mix, release

#: Pieces that a worker remembers at most, about, and between tasks.
CACHE_PIECES, KEPT_PIECES = 800_000, 600_000

#: Pieces whose bounds show in the ids are encoded so many at a time, as one text.
TOGETHER = 64

#: Bytes of the longest piece that the table holds; a longer one is encoded wherever it is. Pieces that are looked up at once.
LONGEST, LOOKED_UP = 31, 1 << 18

_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8-\xaf]|\x81[\x9f-\xaf])|\xe3\x80\x80|\xef\xbb\xbf")
#: What white space other than ASCII begins with, and special tokens; few texts have any of them.
_WHOLE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb", b"<|")

#: Bytes that no UTF-8 has: one around each text, and one that stands for a text that is encoded whole.
_BOUND, _ODD = b"\xff", b"\xfe"
_SPACE, _MARK, _LETTER, _BETWEEN = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK  # not the apostrophe: it begins matches that letters end
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0xFF] = _BETWEEN
_CLASSES = _CLASS.tobytes()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _bounds(raw: np.ndarray, classes: np.ndarray, ascii_only: bool, spaces_dropped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces start and end. The first byte and the last are _BOUND."""
    space, letter = classes == _SPACE, classes == _LETTER
    if not ascii_only:  # two bytes are a Latin letter, too. Times and division signs are none, and lower case turns U+0130 into a letter and a mark, which goes with what follows
        lead, after = raw[:-1], raw[1:]
        letter[1:] |= (lead >= 0xC3) & (lead <= 0xC9) & (after >= 0x80) & (after <= 0xBF) & ~((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((lead == 0xC4) & (after == 0xB0))
    cut = (classes[1:] == _MARK) & letter[:-1]
    between = classes == _BETWEEN
    if spaces_dropped:
        space |= between
        return np.flatnonzero(~space[1:] & (space[:-1] | cut)) + 1, np.flatnonzero(~space[:-1] & (space[1:] | cut)) + 1
    cut |= between[1:] | between[:-1] | (space[1:] & ~space[:-1])
    cut[1:] |= (raw[1:-1] == 10) & ~space[:-2] & ~space[2:]  # a single new line, which patterns match alone
    starts = np.flatnonzero(cut) + 1
    ends = np.append(starts[1:], len(raw))
    keep = ~between[starts]
    return starts[keep], ends[keep]


def _rows(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of four numbers for each piece of at most LONGEST bytes: its bytes, zeros, and its size in the last byte."""
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    rows = np.zeros((len(starts), 4), np.uint64)
    rows[:, 0] = eight[starts] & _MASK[np.minimum(sizes, 8)]
    for k in range(1, 4):
        far = np.flatnonzero(sizes > 8 * k)
        if len(far):
            rows[far, k] = eight[starts[far] + 8 * k] & _MASK[np.minimum(sizes[far] - 8 * k, 8)]
    rows[:, 3] |= sizes.astype(np.uint64) << np.uint64(56)
    return rows


class _Pieces:
    """Numbers pieces, given as rows, from 0: a hash table in which rows are compared whole."""

    def __init__(self):
        self.n, self.rows, self.slots = 0, np.zeros((1 << 14, 4), np.uint64), np.full(1 << 15, -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def _home(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = rows[:, 0] * _ODDS[0]
            for k in range(1, 4):
                h += rows[:, k] * _ODDS[k]
            return (mix(h) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _widen(self, n: int) -> None:
        """Twice as many slots as n pieces need, at least."""
        self.slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
        left, at = np.arange(self.n), self._home(self.rows[: self.n])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & len(self.slots) - 1

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        """The number of each row; one that is new gets the next, in any order."""
        out, left, at = np.empty(len(rows), np.int64), np.arange(len(rows)), self._home(rows)
        while len(left):
            code = self.slots[at]
            free = np.flatnonzero(code < 0)
            if len(free):
                if 2 * (self.n + len(free)) > len(self.slots):
                    self._widen(self.n + len(free))
                    at = self._home(rows)
                    continue
                self.slots[at[free]] = -2 - free  # of those that want a slot one gets it
                won = free[self.slots[at[free]] == -2 - free]
                while self.n + len(won) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[self.n : self.n + len(won)] = rows[won]
                self.slots[at[won]] = np.arange(self.n, self.n + len(won))
                self.n += len(won)
                code[free] = self.slots[at[free]]
            same = (self.rows[code] == rows).view(np.uint32).ravel() == 0x01010101
            out[left[same]] = code[same]
            other = np.flatnonzero(~same)
            left, rows, at = left[other], rows[other], at[other] + 1 & len(self.slots) - 1
        return out


class CachedTokenizer:
    """encode(texts) gives all ids one text after the other, and how many each text has.

    most: how many pieces it remembers, if not CACHE_PIECES; three quarters of them between tasks.
    """

    def __init__(self, path: str, spaces_dropped: bool, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = self.lowered = Tokenizer.from_file(path)
        if spaces_dropped:  # words of a-z alone are normal as they are, and a match each
            self.lowered = Tokenizer.from_file(path)
            self.lowered.normalizer, self.lowered.pre_tokenizer = Sequence([]), WhitespaceSplit()
        # several pieces are encoded as one text: words, each of which ends in an id that only ends words, or what new lines divide
        vocabulary, self.by_end = self.tokenizer.get_vocab(), spaces_dropped
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)
        self.bound[[i for t, i in vocabulary.items() if (t.endswith("</w>") if spaces_dropped else t == "Ċ")]] = True
        self.alone = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+" if spaces_dropped else rb" ?[^\t-\r ]+").fullmatch
        self.most, self.index = most, _Pieces()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _encoded(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, rows: np.ndarray, tokenizer) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of pieces, or None if their bounds don't show."""
        sizes, letters = (rows[:, 3] >> np.uint64(56)).astype(np.int64), rows.view(np.uint8).copy()
        letters[np.arange(len(rows)), sizes] = 10
        text = letters[np.arange(LONGEST + 1) <= sizes[:, None]].tobytes()
        stops = np.append(np.cumsum(sizes + 1)[TOGETHER - 1 : -1 : TOGETHER], len(text)).tolist()
        parts = [text[a : b - self.by_end].decode() for a, b in zip([0, *stops], stops, strict=False)]
        ids = np.fromiter(chain.from_iterable(self._encoded(parts, tokenizer)), np.uint32)
        at = np.flatnonzero(self.bound[ids])
        if len(at) != len(rows):
            return None
        lens = np.diff(at, prepend=-1)
        return (ids, lens) if self.by_end else (ids[~self.bound[ids]], lens - 1)

    def _of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of the pieces with these numbers."""
        starts, lens = self.starts[codes], self.lens[codes].astype(np.int64)
        return self.ids[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))], lens

    def _keep(self, codes: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(codes) and codes.max() >= len(self.lens):
            self.starts, self.lens, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.used))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.lens[codes] = lens
        self.starts[codes] = self.n_ids + np.cumsum(lens) - lens
        self.n_ids += len(ids)

    def _keep_each(self, codes: np.ndarray, pieces: list[bytes]) -> None:
        lists = self._encoded([p.decode() for p in pieces])
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self._keep(codes, np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens)

    def _learn(self, first: int) -> None:
        """The ids of all pieces from this number on."""
        rows = self.index.rows[first : self.index.n]
        letters, sizes = rows.view(np.uint8), (rows[:, 3] >> np.uint64(56)).astype(np.int64)
        plain = (_CLASS[letters] == _LETTER) | (np.arange(LONGEST + 1) >= sizes[:, None])
        plain[:, 0] |= (letters[:, 0] == 0x20) & (sizes > 1)
        plain = plain.all(1)
        data, others = rows.tobytes(), np.flatnonzero(~plain)
        pieces = [data[32 * k : 32 * k + n] for k, n in zip(others.tolist(), sizes[others].tolist(), strict=True)]
        alone = np.fromiter((self.alone(p) is not None for p in pieces), bool, len(pieces))
        some, rest = others[alone], others[~alone].tolist()
        for which, tokenizer in ((np.flatnonzero(plain), self.lowered), (some, self.tokenizer)):
            made = self._together(rows[which], tokenizer) if len(which) > TOGETHER else None
            if made:
                self._keep(first + which, *made)
            else:
                rest += which.tolist()
        if rest:
            self._keep_each(first + np.array(rest), [data[32 * k : 32 * k + int(sizes[k])] for k in rest])

    def forget(self, most: int) -> None:
        """So many pieces stay: those that most calls have used, of late above all."""
        if len(self.index) <= most:
            return
        used = self.used[: len(self.index)]
        keep = np.sort(np.argsort(-used, kind="stable")[:most])
        ids, lens = self._of(keep)
        rows, used = self.index.rows[keep], (used[keep] + 1) // 2
        self.index = _Pieces()
        codes, size = self.index.numbers(rows), 1 << max(14, len(keep).bit_length())
        self.starts, self.lens, self.used = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.used[codes] = used
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self._keep(codes, ids, lens)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        most = self.most or CACHE_PIECES
        if len(self.index) > most:
            self.forget(most // 2)
        text = b"".join([_BOUND, _BOUND.join(texts), _BOUND])
        odd = []
        if any(x[:1] in text and x in text for x in _WHOLE):  # a byte alone is found sooner
            odd = [i for i, t in enumerate(texts) if b"<|" in t or _OTHER_SPACE.search(t)]
        if odd:
            rest = list(texts)
            for i in odd:
                rest[i] = _ODD
            text = b"".join([_BOUND, _BOUND.join(rest), _BOUND])
        n, raw = len(text), np.frombuffer(text + bytes(32), np.uint8)
        strange = np.count_nonzero(raw >= _ODD[0])
        if strange != max(len(texts), 1) + 1 + len(odd):
            for t in texts:
                t.decode()  # says what is no UTF-8
        ascii_only = np.count_nonzero(raw >= 0x80) == strange
        starts, ends = _bounds(raw[:n], np.frombuffer(text.translate(_CLASSES), np.uint8), ascii_only, self.by_end)
        sizes, known = ends - starts, len(self.index)
        bounds = np.flatnonzero(raw[:n] == _BOUND[0])[1 : len(texts) + 1]
        each = np.diff(np.searchsorted(starts, bounds), prepend=0)
        held = (sizes <= LONGEST) & (raw[starts] != _ODD[0])
        some, whole, codes = np.flatnonzero(held), np.flatnonzero(~held), np.empty(len(starts), np.int64)
        lower = np.frombuffer(text.lower() + bytes(32), np.uint8) if self.by_end else raw  # the tokenizer lower-cases, too
        for a in range(0, len(some), LOOKED_UP):
            part = some[a : a + LOOKED_UP]
            rows = _rows(lower, starts[part], sizes[part])
            if self.by_end and not ascii_only:
                other = np.flatnonzero((rows & np.uint64(0x8080808080808080)).any(1))
                rows[other] = _rows(raw, starts[part[other]], sizes[part[other]])  # but only after it joins letters and accents
            codes[part] = self.index.numbers(rows)
        if len(self.index) > known:
            self._learn(known)
        self.used[codes[some]] += 1  # once for all occurrences in these texts
        n_ids = self.n_ids
        if len(whole):  # for this call only
            left = iter(odd)
            pieces = [texts[next(left)] if raw[a] == _ODD[0] else text[a:b] for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)]
            number = {p: len(self.index) + k for k, p in enumerate(dict.fromkeys(pieces))}
            codes[whole] = [number[p] for p in pieces]
            self._keep_each(np.fromiter(number.values(), np.int64, len(number)), list(number))
        flat, lens = self._of(codes)
        self.n_ids = n_ids
        return flat, np.diff(np.concatenate([[0], np.cumsum(lens)])[np.cumsum(each)], prepend=0)


@contextmanager
def tokenizer(path: str, spaces_dropped: bool, most: int | None = None) -> Iterator[CachedTokenizer]:
    """The tokenizer of this Python worker, for one task: later ones find its commonest pieces.

    Other tokenizers are forgotten, and this one as soon as the worker reads texts for other work.
    """
    key = ("tokenizer", path, spaces_dropped, most)
    made = REMEMBERED.get(key) or CachedTokenizer(path, spaces_dropped, most)
    REMEMBERED.clear()
    REMEMBERED[key] = made
    try:
        yield made
    finally:
        made.forget(most * 3 // 4 if most else KEPT_PIECES)
        release()
