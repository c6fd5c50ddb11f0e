"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, padded, rotated at random and reduced to the signs of their components, with two correction
scalars. A rotated query is rounded to a few bits a component, which are kept as planes: a code's inner product with it is
the number of bits that the code shares with each plane, counted on packed words. With the scalars this gives an estimate
of the vectors' inner product and a bound of its error; vectors whose upper bound reaches the k-th largest that is known
by then are compared exactly.

All rows are indexed and all codes are looked at, for blocks of queries of bounded size: each block is sent to the tasks,
which read the index where it lies; the index is neither shuffled nor copied.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import scratch, stored, with_row_id

#: Code bits per component, bits of a query's component, and how many standard deviations an error bound spans.
BITS_PER_DIM, PLANES, EPSILON, SEED = 4, 4, 2.5, 20240607

#: Bytes of a block of queries, about, and rows of the index that are looked at together.
QUERY_BYTES, ROWS = 16 << 20, 1 << 15

#: Stands for a null vec_id among candidates: such come last of equal ones.
NO_ID = (1 << 63) - 1

#: Partial results of so many tasks are merged at a time.
MERGE = 64


class Index(NamedTuple):
    """rows: rid, vec_id, vector (float64 bytes), code (packed bits), length and fit of what the code stands for."""

    rows: DataFrame
    centre: np.ndarray
    rotation: np.ndarray


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dim orthonormal rows of bits components each: pads a vector and rotates it."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def _vectors(batch) -> tuple[np.ndarray, np.ndarray]:
    """Those rows of a batch that take part, and their vectors: finite, without nulls, not zero."""
    keep, out = [], []
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append(i)
                out.append(x)
    return np.array(keep, np.int64), out


def build_index(vectors: DataFrame, bits_per_dim: int = BITS_PER_DIM) -> Index | None:
    """Indexes every vector of the commonest size; None if there is none.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do vectors of
    another size. Rows that repeat are indexed each.
    """
    import pyarrow as pa

    rows = with_row_id(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")))

    def valid(batches):
        for batch in batches:
            keep, out = _vectors(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(pa.array(keep)), batch.column("vec_id").take(pa.array(keep)), pa.array([len(x) for x in out], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["rid", "vec_id", "dim", "vector"]
            )

    whole = stored(rows.mapInArrow(valid, "rid long, vec_id long, dim int, vector binary"), "vectors")
    sizes = whole.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return None
    dim, n = sizes
    whole = whole.where(F.col("dim") == dim)

    def sums(batches):
        total = np.zeros(dim)
        for batch in batches:
            if batch.num_rows:
                total += np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, dim).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], names=["pos", "total"])

    parts = whole.mapInArrow(sums, "pos int, total double").groupBy("pos").agg(F.sum("total")).collect()  # dim rows
    centre = np.zeros(dim)
    for pos, total in parts:
        centre[pos] = total / n
    bits = -(-dim * bits_per_dim // 64) * 64
    turn = rotation(dim, bits)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, dim) - centre
            length = np.linalg.norm(x, axis=1)
            turned = (x / np.maximum(length, 1e-300)[:, None]) @ turn
            fit = np.abs(turned).sum(1) / np.sqrt(bits)  # inner product of the unit vector and its code
            codes = np.packbits(turned > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vec_id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(np.maximum(fit, 1e-12))], names=["rid", "vec_id", "vector", "code", "length", "fit"]
            )

    coded = whole.mapInArrow(encode, "rid long, vec_id long, vector binary, code binary, length double, fit double")
    return Index(stored(coded, "codes"), centre, turn)


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class Queries(NamedTuple):
    """A block of queries: rows' numbers, vectors, and of the rotated ones the lowest component, the step, their sum, and the planes."""

    rid: np.ndarray
    vector: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    planes: np.ndarray  # (queries, PLANES, words) of uint64


def rounded(rid: np.ndarray, vector: np.ndarray, turn: np.ndarray) -> Queries:
    turned = vector @ turn
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(levels >> b & 1, axis=1) for b in range(PLANES)], 1)
    return Queries(rid, vector, low, step, low * turned.shape[1] + step * levels.sum(1), np.ascontiguousarray(planes).view(np.uint64))


def estimates(words: list[np.ndarray], ones: np.ndarray, queries: Queries, i: int) -> np.ndarray:
    """The inner products of query i's rounded components with codes, taken as signs. words: of all codes the first 64 bits, the next, ..."""
    shared = np.zeros(len(ones), np.int32)
    for b in range(PLANES):
        for w, column in enumerate(words):
            shared += np.bitwise_count(column & queries.planes[i, b, w]).astype(np.int32) << b
    return 2 * (queries.low[i] * ones + queries.step[i] * shared) - queries.total[i]


def _search(sent, centre: np.ndarray, bits: int, k: int, epsilon: float):
    """qrid, task, top: the task's k nearest of its index rows for each query, best first."""
    import pyarrow as pa
    from pyspark import TaskContext

    kind = pa.list_(pa.struct([("down", pa.float64()), ("vec_id", pa.int64()), ("rid", pa.int64())]))

    def run(batches):
        queries, dim = sent.value, len(centre)
        n = len(queries.rid)
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        least = np.full(n, -np.inf)
        norm, middle = np.linalg.norm(queries.vector, axis=1), queries.vector @ centre

        def look(parts):
            x, code = (np.concatenate([_matrix(b.column(c), t, w) for b in parts]) for c, t, w in (("vector", np.float64, dim), ("code", np.uint8, bits // 8)))
            words = [np.ascontiguousarray(c) for c in code.view(np.uint64).T]
            ones = np.bitwise_count(code.view(np.uint64)).sum(1, dtype=np.int32)
            length, fit, rid = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("length", "fit", "rid"))
            vec_id = np.concatenate([b.column("vec_id").fill_null(NO_ID).to_numpy() for b in parts])
            scale = length / fit / np.sqrt(bits)
            spread = length * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * epsilon / np.sqrt(max(1, bits - 1))
            for i in range(n):
                guess = estimates(words, ones, queries, i) * scale + middle[i]
                # the code's own error, that of the query's rounding (of even spread within a step), and that of the arithmetic
                margin = norm[i] * spread + scale * (epsilon * queries.step[i] * np.sqrt(bits / 12)) + 1e-9 * (1 + np.abs(guess))
                own = rid == queries.rid[i]
                low = np.where(own, -np.inf, guess - margin)
                floor = max(least[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf)
                near = np.flatnonzero((guess + margin >= floor) & ~own)
                if not len(near):
                    continue
                score = (x[near] * queries.vector[i]).sum(1)  # row by row, so that equal vectors have equal scores
                score, ids, rows = (np.concatenate(c) for c in zip(best[i], (score, vec_id[near], rid[near]), strict=True))
                order = np.lexsort((rows, ids, -score))[:k]
                best[i] = score[order], ids[order], rows[order]
                if len(order) == k:
                    least[i] = score[order[-1]]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                look(held)
                held, size = [], 0
        if size:
            look(held)
        tops = [[{"down": -s, "vec_id": v, "rid": r} for s, v, r in zip(*(c.tolist() for c in b), strict=True)] for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(queries.rid), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(tops, kind)], names=["qrid", "task", "top"])

    return run


def nearest(index: Index, is_query, k: int = 20, query_bytes: int = QUERY_BYTES, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the index with the largest inner product with each query.

    Queries are the index rows for which the condition is_query holds; a row is no neighbour of its own, but a row with
    equal vector is. Ties go to the smaller vec_id, and rows with a null vec_id, which are candidates like all others
    and stay null, come last of equal ones. With fewer than k candidates all are returned. Every block of queries reads
    the index once; a task answers with k rows a query.
    """
    spark = index.rows.sparkSession
    queries = stored(index.rows.where(is_query).select(F.col("rid").alias("qrid"), F.col("vec_id").alias("query_id"), "vector"), "queries")
    dim, bits = index.rotation.shape
    blocks = max(1, -(-queries.count() * dim * 8 // query_bytes))
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("qrid"), F.lit(blocks)))
    path = scratch(spark, "found")
    schema = "qrid long, task int, top array<struct<down:double,vec_id:long,rid:long>>"
    for part in range(blocks):
        some = numbered.where(F.col("part") == part).select("qrid", "vector").collect()  # query_bytes, about
        if some or part == blocks - 1:
            vectors = np.frombuffer(b"".join(bytes(r.vector) for r in some)).reshape(-1, dim)
            sent = spark.sparkContext.broadcast(rounded(np.array([r.qrid for r in some], np.int64), vectors, index.rotation) if some else Queries(np.zeros(0, np.int64), *[np.zeros((0, dim))] * 5))
            index.rows.mapInArrow(_search(sent, index.centre, bits, k, epsilon), schema).write.mode("append").parquet(path)
            sent.unpersist()
    found = spark.read.schema(schema).parquet(path)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    merged = found.groupBy("qrid", F.floor(F.col("task") / MERGE)).agg(best).groupBy("qrid").agg(best)
    near = merged.join(queries.select("qrid", "query_id"), "qrid").select("query_id", F.posexplode("top").alias("pos", "near"))
    return near.select("query_id", (F.col("pos") + 1).alias("rank"), F.when(F.col("near.vec_id") != NO_ID, F.col("near.vec_id")).alias("vec_id"), (-F.col("near.down")).alias("score"))


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by every. An empty table gives an empty table."""
    index = build_index(vectors)
    if index is None:  # no vector that takes part
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return nearest(index, F.col("vec_id") % every == 0, k)
