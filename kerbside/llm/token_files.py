"""Token ids in patched frame-of-reference blocks.

A segment is one binary value: a head, the start of each block, and the blocks. A block subtracts its least id,
packs the differences at the width that a percentile of them fits in, and lists those that don't fit with their
places. Segments are rows of Parquet files, so that any store that Spark reaches can hold them; beside its payload
a row has the doc_ids and lengths of its documents and the number of ids before it in its file.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.llm.common import texts_of

MAGIC = b"KPF1"
BLOCK_IDS = 1024
PERCENTILE = 0.9

#: Ids of a segment, about.
SEGMENT_IDS = 1 << 19

SEGMENT_SCHEMA = "shard long, seq long, base long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> bytes:
    """ids (unsigned 32-bit) as a segment."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, blocks = len(ids), -(-len(ids) // block_ids)
    head = MAGIC + struct.pack("<III", n, block_ids, blocks)
    if not n:
        return head + np.zeros(1, "<u8").tobytes()
    least = np.minimum.reduceat(ids, np.arange(0, n, block_ids))
    grid = np.concatenate([ids, np.repeat(least[-1:], blocks * block_ids - n)]).reshape(blocks, block_ids) - least[:, None]
    bits = np.frexp(grid.astype(np.float64))[1]  # 0 for 0, else the width
    counts = np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=blocks * 33).reshape(blocks, 33)
    widths = (counts.cumsum(1) < percentile * block_ids).sum(1)
    over = bits > widths[:, None]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        spread = ((grid[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        rows = np.packbits(spread.reshape(len(at), -1), axis=1, bitorder="little") if w else np.zeros((len(at), 0), np.uint8)
        for i, row in zip(at, rows, strict=True):
            packed[i] = row.tobytes()
    body = []
    for i in range(blocks):
        places = np.flatnonzero(over[i])
        body.append(struct.pack("<IHI", int(least[i]), int(widths[i]), len(places)) + packed[i] + places.astype("<u4").tobytes() + grid[i, places].astype("<u4").tobytes())
    starts = np.cumsum([0, *map(len, body)]).astype("<u8")
    return head + starts.tobytes() + b"".join(body)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids at places first to last (exclusive) of a segment; only the blocks that hold them are read."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, block_ids, blocks = struct.unpack_from("<III", data, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u8", blocks + 1, 16).astype(np.int64) + 16 + 8 * (blocks + 1)
    lo, hi = first // block_ids, -(-last // block_ids)
    heads = [struct.unpack_from("<IHI", data, starts[i]) for i in range(lo, hi)]
    out = np.zeros((hi - lo, block_ids), np.uint32)
    widths = np.array([h[1] for h in heads])
    for w in np.unique(widths[widths > 0]):
        at, size = np.flatnonzero(widths == w), -(-block_ids * int(w) // 8)
        raw = np.zeros((len(at), size + 5), np.uint8)
        for row, i in enumerate(at):
            raw[row, :size] = np.frombuffer(data, np.uint8, size, starts[lo + i] + 10)
        bit = np.arange(block_ids) * int(w)
        value = np.zeros((len(at), block_ids), np.uint64 if w > 25 else np.uint32)
        for j in range((int(w) + 14) // 8):  # the bytes that a difference reaches into
            value |= raw[:, (bit >> 3) + j].astype(value.dtype) << value.dtype.type(8 * j)
        out[at] = value >> (bit & 7).astype(value.dtype) & value.dtype.type((1 << int(w)) - 1)
    for i, (least, w, k) in enumerate(heads):
        if k:
            p = starts[lo + i] + 10 + -(-block_ids * w // 8)
            out[i, np.frombuffer(data, "<u4", k, p)] = np.frombuffer(data, "<u4", k, p + 4 * k)
        out[i] += np.uint32(least)
    return out.ravel()[first - lo * block_ids : last - lo * block_ids]


def _writer(tokenizer_path: str, spaces_dropped: bool, end_id: int, segment_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from kerbside.llm.common import by_bytes
        from kerbside.llm.tokens import tokenizer

        shard, seq, base, held = TaskContext.get().partitionId(), 0, 0, []

        def segment():
            nonlocal seq, base, held
            ids = np.concatenate([x[2] for x in held])
            row = [[shard], [seq], [base], [len(ids)], [[d for x in held for d in x[0]]], [np.concatenate([x[1] for x in held])], [pack(ids)]]
            seq, base, held = seq + 1, base + len(ids), []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["shard", "seq", "base", "n_ids", "doc_ids", "lengths", "payload"])

        with tokenizer(tokenizer_path, spaces_dropped) as t:
            for batch, texts in by_bytes(batches, remember=True):
                flat, counts = t.encode(texts)
                ids = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                held.append((batch.column("doc_id").to_pylist(), counts + 1, ids))
                if sum(len(x[2]) for x in held) >= segment_ids:
                    yield segment()
            if held:
                yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, spaces_dropped: bool, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every whole text, appends end_id to each, and writes the ids to path in ascending doc_id order.

    A null text is empty: it has end_id alone. Null doc_ids come first; rows that repeat a doc_id follow each other in
    the order of a hash of their texts. An empty table writes no segment. Texts are dealt out by ranges of doc_id, and
    rows that repeat one by that hash and a number of the row, so that they needn't be in one range; each range is
    sorted and encoded by one task, which writes one file.
    """
    rows = texts_of(docs)
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))  # _row only parts rows that are the same
    ordered = rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, spaces_dropped, end_id, segment_ids), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def _reader(batches):
    import zlib

    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - row["lengths"], ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files at path."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per file
    offsets = totals.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    each = files.mapInArrow(_reader, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return each.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array of long) of each document, from the files at path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = pa.array(unpack(row["payload"]).astype(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(offsets, ids)], names=["doc_id", "ids"])

    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")
