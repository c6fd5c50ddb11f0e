"""Helpers that several operators share: scratch tables, whole texts as bytes, word and window hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Bytes of text that a task handles at a time, rows and bytes of an Arrow batch at most (a longer row is a batch of its
#: own), and bytes of a row group of stored tables, about.
CHUNK_BYTES, BATCH_ROWS, BATCH_BYTES, GROUP_BYTES = 1 << 20, 2000, 4 << 20, 16 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where none is set and all run on one machine, as in tests, one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kerbside-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: later reads survive lost executors and don't compute it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most BATCH_ROWS rows and BATCH_BYTES: many long texts fill executors' memory."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, most)


def texts_of(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text of docs, and further columns, in batches of few rows."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def unused(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _plain(df: DataFrame) -> bool:
    """Whether df is one table with columns and rows left out at most, so that no row is there twice."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation")


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """df, a table of Parquet files, with a number for each row; doc_id may repeat or be null, this doesn't.

    It is made of the number of the row's file and the row's place in it, so that it's the same whenever and by however
    many tasks the files are read. What is no table of files, or more than a selection of one's columns and rows (an
    exploded, joined or united table repeats the places of its rows), is written first.
    """
    spark, file = df.sparkSession, unused(df, "_file")
    if not _plain(df):
        return with_row_id(stored(df, "rows"), name)
    try:
        meta = df.metadataColumn("_metadata")
        placed = df.select("*", F.regexp_replace(meta.getField("file_path"), "^([^:/]+):/+", "$1:/").alias(file), meta.getField("row_index").alias(name))
        placed.schema  # noqa: B018  (Spark says only here that there is no such column)
        files = {re.sub("^([^:/]+):/+", r"\1:/", f) for f in df.inputFiles()}
    except AnalysisException:
        return with_row_id(stored(df, "rows"), name)
    if len(files) > 1:  # a row per file, all of which the driver lists for each scan anyway
        numbers = spark.createDataFrame(list(enumerate(sorted(files))), f"_number long, `{file}` string")
        placed = placed.join(F.broadcast(numbers), file, "left")
        number = F.coalesce("_number", F.raise_error(F.concat(F.lit("not among the files of the table: "), F.col(file))).cast("long"))
        placed = placed.withColumn(name, F.shiftleft(number, 40) + F.col(name))
    return placed.select(*df.columns, name)


def utf8(column) -> list[bytes]:
    """Texts of an Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _UP, _DOWN
    if len(_UP) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _UP = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _STEP))])
            _DOWN = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, np.uint64(pow(int(_STEP), -1, 1 << 64))))])
    return _UP[:n], _DOWN[:n]


_UP = _DOWN = np.ones(1, np.uint64)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ of the texts, one text after the other, and how many each text has.

    Sums of byte codes times powers of an odd number, taken for all words at once from running sums.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    at = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        at = np.concatenate([[0], at])
    starts, ends = at[0::2], at[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
        words = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive words; runs over the ends of texts are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * _STEP + words[i : i + n]
        return mix(total)


def release() -> None:
    """Gives back what memory a task has left free: Python workers live on, and an executor has several."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other systems have no such function
        ctypes.CDLL(None).malloc_trim(0)


#: What this Python worker remembers from one task to the next of the same work. Workers serve all operators of a session.
REMEMBERED: dict = {}


def by_bytes(batches: Iterable, limit: int = CHUNK_BYTES, remember: bool = False) -> Iterator[tuple]:
    """(record batch slice, its texts as bytes) for about limit bytes of text at a time.

    What tasks of other work have left in this worker goes first, unless remember.
    """
    if REMEMBERED and not remember:
        REMEMBERED.clear()
        release()
    texts = batch = None
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in chunks(texts, limit):
            yield batch.slice(a, b - a), texts[a:b]
    del texts, batch
    release()


def blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]):
    """A row per bucket with the values of each column in it, as bytes."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(bucket)) if len(bucket) else first
    out = [pa.array(sorted_[first].astype(np.int64))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        out.append(pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *columns])


def unblob(table, column: str, kind) -> np.ndarray:
    """All values of a column that blobs() made."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


#: Bits of a bitmap for each value, and of a bitmap at least and at most.
BITMAP_SHARE, BITMAP_LEAST, BITMAP_MOST = 16, 1 << 20, 1 << 26
_BITMAP_PART = 1 << 15


def _bits_of(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(values.astype(np.int64).view(np.uint64))
    return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap by which in_bitmap() finds all values of a column of a stored table again, and a few others.

    Its size follows the number of rows up to 8 MB; with more rows it finds more others. Tasks build it and merge it
    part by part; only the whole comes to the driver.
    """
    import pyarrow as pa

    size = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << (BITMAP_SHARE * df.count()).bit_length()))

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _bits_of(batch.column("v").to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = bits.reshape(-1, _BITMAP_PART)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def merge(table):
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for part, data in df.select(F.col(column).alias("v")).mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(merge, "part long, bits binary").collect():
        bits[part * _BITMAP_PART : (part + 1) * _BITMAP_PART] = np.frombuffer(data, np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    a, b = _bits_of(values, 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, a table of files, without the rows whose numbers (see with_row_id) are in dropped (rid).

    Rows that a bitmap of fixed size tells to stay aren't shuffled; the others are joined.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    rid = unused(docs, "rid")
    rows = with_row_id(docs, rid)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(dropped, "rid"))

    def those(found: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(sent.value, batch.column(rid).to_numpy()) == found))

        return rows.mapInArrow(run, rows.schema)

    gone = dropped.select(F.col("rid").alias(rid))
    return those(False).unionByName(those(True).join(gone, rid, "left_anti")).select(*docs.columns)
