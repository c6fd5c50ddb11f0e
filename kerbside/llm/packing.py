"""Best-fit packing by minimum bin slack.

A document's ids are cut into pieces of at most the capacity. Packing needs only how many pieces have each length,
a table of at most capacity rows: per bin, a bitset of reachable sums over the lengths still available finds the
fullest combination with the longest piece left, which is removed. A combination is used as often as its lengths
last, so the plan is as long as there are lengths, not bins. Then each piece finds its place from its number among
the pieces of its length, which is counted where the pieces are and summed over tasks, not sorted out in one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import stored, texts_of

CAPACITY = 1024


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """How many of each length (given longest first) make the largest sum of at most room."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        k = 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] += k
            total -= length * k
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, how many of each length) for all bins."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    bins = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        used = fullest(counts, capacity - longest, lengths)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        bins.append((times, used))
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order: (number of its first piece, first bin, pieces per bin, offset in the bin)."""
    out, seen, first = defaultdict(list), defaultdict(int), 0
    for times, used in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            out[length].append((seen[length], first, used[length], offset))
            seen[length] += times * used[length]
            offset += length * used[length]
        first += times
    return dict(out)


def _cut(tokenizer_path: str, spaces_dropped: bool, end_id: int, capacity: int, remembered: int | None):
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from kerbside.llm.common import by_bytes
        from kerbside.llm.tokens import tokenizer

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        with tokenizer(tokenizer_path, spaces_dropped, remembered) as t:
            for batch, texts in by_bytes(batches, remember=True):
                flat, counts = t.encode(texts)
                ids = np.insert(flat, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                ends = np.cumsum(counts + 1)
                doc, piece, start, length, crc, nth = [], [], [], [], [], []
                for d, a, b in zip(batch.column("doc_id").to_pylist(), ends - counts - 1, ends, strict=True):
                    n = int(b - a)
                    stops = list(range(n % capacity or min(n, capacity), n + 1, capacity))
                    for i, stop in enumerate(stops):
                        begin = stops[i - 1] if i else 0
                        size = stop - begin
                        for column, v in ((doc, d), (piece, i), (start, begin), (length, size), (crc, zlib.crc32(ids[a + begin : a + stop].tobytes())), (nth, seen[size])):
                            column.append(v)
                        seen[size] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [doc, piece, start, length, crc, nth, [part] * len(doc)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, spaces_dropped: bool = False, capacity: int = CAPACITY, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is a piece of end_id alone; a null doc_id stays null; rows that repeat are packed
    each. Documents longer than capacity are cut so that the first piece takes what is over. An empty table gives an
    empty table. Columns other than doc_id and text are ignored, whatever their names. remembered: how many different
    pieces of text a worker remembers; fewer take less memory and more time.
    """
    rows = texts_of(docs)
    cut = rows.mapInArrow(_cut(tokenizer_path, spaces_dropped, end_id, capacity, remembered), "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long")
    pieces = stored(cut, "pieces")
    each = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = each.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    where = places(plan(histogram, capacity))

    def put(batches):
        import pandas as pd

        for b in batches:
            number = (b["before"] + b["nth"]).to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths = b["length"].to_numpy()
            for size in np.unique(lengths):
                rows, slots = np.flatnonzero(lengths == size), where[int(size)]
                starts, first, per_bin, at = (np.array(x) for x in zip(*slots, strict=True))
                k = np.searchsorted(starts, number[rows], "right") - 1
                rest = number[rows] - starts[k]
                sequence[rows] = first[k] + rest // per_bin[k]
                offset[rows] = at[k] + rest % per_bin[k] * size
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "start": b["start"], "length": b["length"], "ids_crc32": b["ids_crc32"], "sequence_id": sequence, "offset": offset})

    joined = pieces.join(before, ["length", "part"])
    return joined.mapInPandas(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
