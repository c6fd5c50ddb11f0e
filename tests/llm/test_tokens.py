import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from kerbside.llm import bpe, packing, token_files, tokens
from kerbside.llm.common import by_bytes, scratch
from tokenizers import Tokenizer

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PLAIN, CACHED = {path: plain(path) for path in (WORD, BYTE)}, {}

BITS = ["a", "The", "don't", "'s", "word", "ß", "é", "É", "H\u0331", "×", "x.", "!!", "***", "12", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\u00a0", "\x1c", "\u3000", "«", "»", "日本", "\U0001f600", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]


@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), max_size=30))
@settings(max_examples=150, deadline=None)
@pytest.mark.parametrize(("path", "spaces_dropped"), [(WORD, True), (BYTE, False)])
def test_pieces_give_the_ids_of_whole_texts(path, spaces_dropped, texts):
    # one tokenizer for all examples, which forgets again and again
    cached = CACHED.setdefault(path, tokens.CachedTokenizer(path, spaces_dropped))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "CACHE_PIECES", 60)
        m.setattr(tokens, "TOGETHER", 3)
        ids, counts = cached.encode([t.encode() for t in texts])
    want = [PLAIN[path](t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_a_worker_forgets_its_pieces_when_it_reads_texts_for_other_work():
    batch = pa.RecordBatch.from_pydict({"text": ["some text", None]})

    def known(path=BYTE):
        """How many pieces a task finds; it leaves two."""
        with tokens.tokenizer(path, path == WORD) as t:
            n = len(t.index)
            for _, texts in by_bytes([batch], remember=True):
                t.encode(texts)
        return n

    known()
    assert known() == 2
    list(by_bytes([batch]))
    assert known() == 0 and known() == 2
    assert known(WORD) == 0 and known() == 0  # one tokenizer at a time


def test_a_worker_remembers_as_many_pieces_as_it_is_told():
    texts = [f"{i} some text" for i in range(100)]
    for most, left in ((8, 6), (None, 102)):
        with tokens.tokenizer(BYTE, False, most) as t:
            for text in texts:
                ids, _ = t.encode([text.encode()])
                assert ids.tolist() == PLAIN[BYTE](text) and (most is None or len(t.index) <= most + 3)
        assert len(t.index) <= left and (most or len(t.index) == left)


@pytest.mark.parametrize(("path", "spaces_dropped"), [(WORD, True), (BYTE, False)])
def test_marks_after_every_latin_letter(path, spaces_dropped):
    texts = [f"{a}{chr(c)}{b}{marks}" for c in range(0xC0, 0x250) for a in ("", "x") for b in ("", "y") for marks in ("--", ".", "'s")]
    ids, counts = tokens.CachedTokenizer(path, spaces_dropped).encode([t.encode() for t in texts])
    want = [PLAIN[path](t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_word_is_one_piece_in_any_case_and_with_any_marks():
    cached = tokens.CachedTokenizer(WORD, True)
    texts = ["Word, word. WORD!) word", "ñ Word; wORD", ""]
    ids, counts = cached.encode([t.encode() for t in texts])
    want = [PLAIN[WORD](t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(cached.index) == 6  # word , . !) ; ñ


@pytest.mark.parametrize(("path", "spaces_dropped"), [(WORD, True), (BYTE, False)])
def test_pieces_of_one_slot_and_of_all_sizes(path, spaces_dropped, monkeypatch):
    monkeypatch.setattr(tokens._Pieces, "_home", lambda self, rows: np.zeros(len(rows), np.int64))
    monkeypatch.setattr(tokens, "LOOKED_UP", 50)
    cached = tokens.CachedTokenizer(path, spaces_dropped, 150)
    texts = [" ".join(a * n + b for n in range(1, 40) for b in ("", "\x00", "1", "é")) for a in ("x", "Y", "ß")] * 2
    for text in texts:
        ids, counts = cached.encode([text.encode(), b"x"])
        want = PLAIN[path](text) + PLAIN[path]("x")
        assert ids.tolist() == want and counts.sum() == len(want)


def test_bytes_that_are_no_utf8_fail():
    with pytest.raises(UnicodeDecodeError):
        tokens.CachedTokenizer(BYTE, False).encode([b"a \xff b"])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(1, 300))
@settings(max_examples=60, deadline=None)
def test_segment_round_trip(ids, block):
    data = token_files.pack(np.array(ids, np.uint32), block)
    assert token_files.unpack(data).tolist() == ids
    a, b = len(ids) // 3, len(ids) // 2
    assert token_files.unpack(data, a, b).tolist() == ids[a:b]


def test_outliers_are_exceptions_and_small():
    ids = np.concatenate([np.arange(5000) % 16, [4_000_000_000]]).astype(np.uint32)
    data = token_files.pack(ids)
    assert len(data) < 5000 and (token_files.unpack(data) == ids).all()


def test_token_files(spark, odd_docs):
    path, encode = scratch(spark, "t"), plain(WORD)
    token_files.write_tokens(odd_docs, path, WORD, 2, True, segment_ids=1000)
    got = token_files.read_digests(spark, path).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(encode(r.text) + [2])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), crc(i)) for d, x in texts.items() for i in x)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert keys == sorted(keys)
    ids = {r.doc_id: r.ids for r in token_files.read_ids(spark, path).where("doc_id > 99").collect()}
    assert all(ids[d] == texts[d][0] for d in ids)


def test_token_files_of_nothing(spark, no_docs):
    path = scratch(spark, "t")
    token_files.write_tokens(no_docs, path, WORD, 2, True)
    assert token_files.read_digests(spark, path).count() == 0


def check_packing(rows, texts, capacity):
    pieces = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        pieces[r.doc_id].append(r)
    for d, many in texts.items():
        if len(many) == 1:
            ids, at = many[0], 0
            for n, r in enumerate(pieces[d]):
                assert (r.piece, r.start, r.ids_crc32) == (n, at, crc(ids[at : at + r.length]))
                assert r.length == capacity or n == 0
                at += r.length
            assert at == len(ids) and len(pieces[d]) == -(-len(ids) // capacity)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return bins


def test_packing(spark, odd_docs):
    encode = plain(BYTE)
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(encode(r.text) + [2])
    rows = packing.pack_documents(odd_docs, BYTE, 2).collect()
    assert sum(r.length for r in rows) == sum(len(i) for x in texts.values() for i in x)
    bins = check_packing(rows, texts, 1024)
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, BYTE, 2).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    used = Counter()
    for times, one in packing.plan(histogram, 64):
        assert 0 < sum(k * n for k, n in one.items()) <= 64
        for k, n in one.items():
            used[k] += times * n
    assert used == Counter(histogram)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 60))
@settings(max_examples=80, deadline=None)
def test_fullest_is_the_largest_sum(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + i * k for s in sums for i in range(n + 1)}
    used = packing.fullest(counts, room, sorted(counts, reverse=True))
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_tiktoken(spark, odd_docs, no_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    for limit in (1000, bpe.SPLIT_CHARS):
        encoded = bpe.encode_documents(odd_docs, RANKS, P.PATTERN, limit)
        assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    decoded = bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd_docs.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.digests(odd_docs, RANKS, P.PATTERN).collect())
    assert got == sorted((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in want)
    assert bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a b\tc\n\nd  ", "  lead", "x\x1c \x1c y", "  a 　b"])
def test_cuts_are_safe(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [i for p in bpe.pieces(text, 1) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
