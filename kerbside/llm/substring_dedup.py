"""Removal of repeated passages: seed and extend.

Of each window of so many words the least k-gram is its anchor, so equal windows have equal anchors wherever they
stand. Documents are joined on their anchors; where an anchor occurs again, it is extended both ways to all the
windows that it anchors, and a window is a repeat if the extension is the same somewhere else. Repeats that follow one
another make a maximal one. All words of maximal repeats are removed.

Nothing is paired: an anchor or window that a task holds many times leaves it once, marked as repeated, so that a
passage which a third of all texts hold puts no more into one task than there are map tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import CHUNK_BYTES, bitmap, blobs, gram_hashes, in_bitmap, mix, stored, texts_of, unblob, utf8, with_row_id, word_hashes

WINDOW, SEED_WORDS = 35, 16

#: Anchors or windows that a map task gathers before it sends them.
HELD = 1_000_000

#: Bytes of text for each bucket, the least number of buckets, and how many of them go to one bucket of documents.
BUCKET_BYTES, LEAST_BUCKETS, SHARED = 10 << 20, 1024, 4


def anchors(words: np.ndarray, lens: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words follow each other: the starts of all windows within a text, the place of each one's anchor, and all k-grams."""
    grams = gram_hashes(words, seed)
    width = window - seed + 1
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    best, have = np.arange(len(grams)), 1
    while have < width:  # the least of have grams from each place on; of equal ones the last
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] < grams[b], a, b)
        have += step
    owner = np.repeat(np.arange(len(lens)), lens)
    start = np.flatnonzero(owner[: len(words) - window + 1] == owner[window - 1 :])
    return start, best[start], grams


def _chunks(batches):
    """rid, texts and, if there are such columns, positions or spans, of about CHUNK_BYTES at a time."""
    for batch in batches:
        texts = utf8(batch.column("text"))
        start, size = 0, 0
        for i, t in enumerate([*texts, None]):
            if t is None or size + len(t) > CHUNK_BYTES and i > start:
                if i > start:
                    yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t or b"")


class _Gathered:
    """Keys with their row and place; flush() tells those that occur again here, and one of each key for the other tasks."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, key: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((key, rid, pos))
        self.size += len(key)

    def flush(self):
        key, rid, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(key, kind="stable")
        key, rid, pos = key[order], rid[order], pos[order]
        same = key[1:] == key[:-1]
        again, first = np.concatenate([[False], same]), np.concatenate([same, [False]])
        many = again | first
        one = ~again
        bucket = ((key[one] >> np.uint64(40)).astype(np.int64) * self.buckets) >> 24
        return (rid[many], pos[many]), blobs(bucket, {"keys": key[one], "rids": rid[one], "places": pos[one].astype(np.int32) | (many[one].astype(np.int64) << 31).astype(np.int32)})


_SENT = "bucket long, known boolean, keys binary, rids binary, places binary"


def _rows(known, sent, buckets: int):
    """What a map task sends: keys by bucket, and what it knows to be repeated, which goes on from any bucket."""
    import pyarrow as pa

    rid, pos = known[0].astype(np.int64), known[1].astype(np.int32)
    for batch, flag in ((sent, False), (blobs(_doc_bucket(rid, buckets), {"keys": np.zeros((len(rid), 0), np.uint8), "rids": rid, "places": pos}), True)):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flag] * batch.num_rows), *batch.columns[1:]], names=["bucket", "known", "keys", "rids", "places"])


def _seeds(buckets: int, window: int, seed: int):
    def run(batches):
        held = _Gathered(buckets)
        for batch, texts in _chunks(batches):
            words, lens = word_hashes(texts)
            _, at, grams = anchors(words, lens, window, seed)
            at = np.unique(at)
            ends = np.cumsum(lens)
            doc = np.searchsorted(ends, at, "right")
            held.add(grams[at], batch.column("rid").to_numpy()[doc], at - (ends - lens)[doc])
            if held.size > HELD:
                yield from _rows(*held.flush(), buckets)
        if held.parts:
            yield from _rows(*held.flush(), buckets)

    return run


def _extended(buckets: int, window: int, seed: int):
    """The windows of repeated anchors. Rows have a text and the places of its repeated anchors."""

    def run(batches):
        held = _Gathered(buckets)
        for batch, texts in _chunks(batches):
            words, lens = word_hashes(texts)
            start, at, _ = anchors(words, lens, window, seed)
            begin = np.cumsum(lens) - lens
            places = batch.column("places")
            counts = np.diff(places.offsets.to_numpy())
            hit = np.zeros(len(words) + 1, bool)
            hit[places.flatten().to_numpy().astype(np.int64) + np.repeat(begin, counts)] = True
            start = start[hit[at]]
            doc = np.searchsorted(begin + lens, start, "right")
            held.add(gram_hashes(words, window)[start] if len(words) >= window else np.zeros(0, np.uint64), batch.column("rid").to_numpy()[doc], start - begin[doc])
            if held.size > HELD:
                yield from _rows(*held.flush(), buckets)
        if held.parts:
            yield from _rows(*held.flush(), buckets)

    return run


def _repeated(buckets: int):
    """Rows and places of a bucket's keys that several tasks hold, and of those known before, dealt by document."""

    def run(table):
        import pyarrow as pa

        told = table.column("known").to_numpy()
        sure, table = table.filter(pa.array(told)), table.filter(pa.array(~told))
        key, rid, place = unblob(table, "keys", np.uint64), unblob(table, "rids", np.int64), unblob(table, "places", np.int32)
        order = np.argsort(key, kind="stable")
        key, rid, place = key[order], rid[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        some = (np.repeat(count, count) > 1) & (place >= 0)  # marked ones are known
        rid, place = np.concatenate([rid[some], unblob(sure, "rids", np.int64)]), np.concatenate([place[some], unblob(sure, "places", np.int32)])
        return pa.Table.from_batches([blobs(_doc_bucket(rid, buckets), {"rids": rid, "places": place})])

    return run


def _doc_bucket(rid: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rid.astype(np.int64).view(np.uint64)) % np.uint64(max(1, buckets // SHARED))).astype(np.int64)


def _by_document(spans_of: int):
    """rid, places of each document of a bucket; spans_of: the places are starts of windows of so many words, told as start, end, ..."""

    def run(table):
        import pyarrow as pa

        rid, place = unblob(table, "rids", np.int64), unblob(table, "places", np.int32)
        order = np.lexsort((place, rid))
        rid, place = rid[order], place[order]
        new = np.concatenate([[True], rid[1:] != rid[:-1]]) if len(rid) else np.zeros(0, bool)
        if spans_of and len(rid):
            opens = new | np.concatenate([[True], place[1:] > place[:-1] + spans_of])  # neither overlaps nor touches the one before
            at = np.flatnonzero(opens)
            last = np.append(at[1:], len(rid)) - 1
            rid, new = rid[at], new[at]
            place = np.column_stack([place[at], place[last] + spans_of]).ravel()
        first = np.flatnonzero(new)
        size = 2 if spans_of else 1
        offsets = np.append(first, len(rid)) * size
        return pa.Table.from_arrays([pa.array(rid[first]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(place.astype(np.int32)))], names=["rid", "places"])

    return run


def _gather(sent: DataFrame, buckets: int, spans_of: int = 0) -> DataFrame:
    """rid, places for what a step's tasks have sent."""
    met = sent.groupBy("bucket").applyInArrow(_repeated(buckets), "bucket long, rids binary, places binary")
    return met.groupBy("bucket").applyInArrow(_by_document(spans_of), "rid long, places array<int>")


def _digest(batches):
    """doc_id, n_words, n_removed, kept_sha256 of each text; places: starts and ends of what is removed, or null."""
    import hashlib

    import pyarrow as pa

    for batch, texts in _chunks(batches):
        n, gone, sha = [], [], []
        for text, places in zip(texts, batch.column("places").to_pylist(), strict=True):
            words = text.split()
            kept = words
            if places:
                kept, at = [], 0
                for a, b in zip(places[0::2], places[1::2], strict=True):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _picked(rows: DataFrame, bits, wanted: bool = True) -> DataFrame:
    """The rows whose rid the bitmap has (or hasn't)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column("rid").to_numpy()) == wanted))

    return rows.mapInArrow(run, rows.schema)


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with rid, and a stored table rid, places: starts and ends of the maximal repeats of a row's words."""
    rows = with_row_id(texts_of(docs))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 24, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    places = stored(_gather(rows.mapInArrow(_seeds(buckets, window, seed), _SENT), buckets), "anchors")
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(places, "rid"))
    texts = _picked(rows, bits).join(places, "rid").select("rid", "text", "places")
    windows = texts.mapInArrow(_extended(buckets, window, seed), _SENT)
    return rows, stored(_gather(windows, buckets, window), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs, without the words of windows that occur again anywhere.

    A null text counts as empty, and a text with fewer words than a window loses none. Repeated rows are copies of each
    other and lose all that a window covers. A null doc_id stays null. An empty table gives an empty table. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    rows, spans = repeats(docs, window, seed)
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(spans, "rid"))
    clean = _picked(rows, bits, False).withColumn("places", F.lit(None).cast("array<int>"))
    rest = _picked(rows, bits).join(spans, "rid", "left").select("rid", "doc_id", "text", "places")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return clean.select("doc_id", "text", "places").mapInArrow(_digest, schema).unionByName(rest.select("doc_id", "text", "places").mapInArrow(_digest, schema))
