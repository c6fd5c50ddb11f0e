"""Exact Jaccard join of n-gram sets by partitioning the universe.

Texts of a size band share a division of all tokens into segments by hash. Two sets that are similar enough differ in
at most H tokens, so at least one of any H + 1 segments that one of them fills is the same in both. A set is indexed
under H + 1 of its filled segments: which, is settled by cost, which is how many sets share a segment. All sets' first
H + 1 segments in one order have to meet, so a set with enough segments of its own is indexed under nothing that any
other has. Where a set fills too few segments, its whole band is indexed under all segments and under their one-deletion neighbourhoods too, which
lets two sets meet in a segment in which they differ by one token; where even that is too little, the band is divided
more finely. What meets is verified exactly.

Sets that are the same are one class. Within a segment's list, members are first compared with the least one only;
links then make components, and only members of different components are compared further. So a list of near copies
costs as many comparisons as it has members. That is enough for components, and similar_groups() computes these only:
links between members of one component, of which one list of near copies has as many as the square of its length, are
neither all found nor given. similar_links() gives all links between different sets, and costs and holds as much.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import bitmap, blobs, by_bytes, chunks, gram_hashes, in_bitmap, mix, stored, texts_of, unblob, utf8, with_row_id, word_hashes
from kerbside.llm.components import components

WORDS, PERCENT = 5, 75

#: Segments of a band as a multiple of its least size; bands below this size have a segment for each token.
SPREAD, THICK = 1.5, 32

#: A key that about so many sets of all share is costly: its list isn't gathered in a task. How many share a key is told
#: by a sketch of two rows of so many counters, which all tasks fill and whose parts are merged, so many tasks' at a time.
COSTLY, COUNTERS, PART, MERGED = 1000, 1 << 20, 1 << 15, 64

#: Keys that are compared in a task at a time, about.
BUCKET_KEYS = 500_000

#: Keys that a map task gathers before it counts or sends them.
HELD = 250_000
LEAST_BUCKETS = 1024

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; with fewer words, all of them as one."""
    words, lens = word_hashes(texts, lower=True)
    grams = gram_hashes(words, k)
    out, at = [], 0
    for n in lens.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        else:
            out.append(mix(gram_hashes(words[at : at + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        at += n
    return out


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = np.array([mix(s ^ _OTHER).sum(dtype=np.uint64) + np.uint64(len(s)) * _GOLD])
    return int(mix(x).view(np.int64)[0])


class Segments(NamedTuple):
    keys: np.ndarray
    sizes: np.ndarray
    deletions: np.ndarray  # keys of segments without one of their tokens


def bands_of(n: int, percent: int = PERCENT) -> list[int]:
    """The bands in which a set of n tokens is indexed: its own, and the one below if similar sets can be in that."""
    own = n.bit_length() - 1
    return [own, own - 1] if own and n * percent <= ((1 << own) - 1) * 100 else [own]


def budget(n: int, percent: int = PERCENT) -> int:
    """H: in how many tokens a set of n tokens can differ from a similar one."""
    return (100 - percent) * n // percent


def segment_keys(s: np.ndarray, band: int, finer: int = 0, spread: float = SPREAD, thick: int = THICK, deletions: bool = False) -> Segments:
    with np.errstate(over="ignore"):
        salt = mix(np.array([band * 64 + finer + 1], np.uint64) * _GOLD)[0]
        if 1 << band < thick:
            return Segments(mix(s ^ salt), np.ones(len(s), np.int64), np.zeros(0, np.uint64))
        segment = mix(s * _GOLD) % np.uint64(int(spread * (1 << band)) << finer)
        order = np.argsort(segment, kind="stable")
        segment, tokens = segment[order], mix(s ^ _OTHER)[order]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums, sizes = np.add.reduceat(tokens, first), np.diff(np.append(first, len(s)))
        name = mix(segment[first] * _OTHER + salt)
        gone = np.zeros(0, np.uint64)
        if deletions:
            many = np.repeat(sizes > 1, sizes)
            gone = mix(np.repeat(sums, sizes)[many] - tokens[many] ^ np.repeat(name, sizes)[many])
        return Segments(mix(sums ^ name), sizes, gone)


def shortage(s: np.ndarray, band: int, percent: int, spread: float, thick: int) -> tuple[int, int] | None:
    """None if the set fills enough segments; else how much finer its band must be, and whether it needs deletions there."""
    need, finer = budget(len(s), percent) + 1, 0
    while True:
        x = segment_keys(s, band, finer, spread, thick)
        if len(x.keys) >= need:
            return (finer, 0) if finer else None
        if len(x.keys) + int((x.sizes > 1).sum()) >= need:
            return finer, 1
        finer += 1


def indexed(s: np.ndarray, band: int, how: tuple[int, int], percent: int, spread: float, thick: int) -> tuple[np.ndarray, int]:
    """A set's keys in a band, their last bit that of the band, and how many of them it needs beyond those that it alone has.

    how: how much finer the band is, and whether with deletions, when all that it shares are needed.
    """
    x = segment_keys(s, band, how[0], spread, thick, bool(how[1]))
    keys = np.concatenate([x.keys, x.deletions]) & ~np.uint64(1) | np.uint64(band & 1)
    return keys, 1 << 30 if how[1] else budget(len(s), percent) + 1 - len(keys)


class Options(NamedTuple):
    words: int = WORDS
    percent: int = PERCENT
    spread: float = SPREAD
    thick: int = THICK
    costly: int = COSTLY


def _counters(keys: np.ndarray) -> list[np.ndarray]:
    """The counter of each key in each row of the sketch."""
    h = mix(keys ^ _OTHER)
    return [(h % np.uint64(COUNTERS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(COUNTERS)).astype(np.int64) + COUNTERS]


def _packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes as they need, compressed: most are 0 or hold few."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"u{len(raw) // PART}")


def _summed(table):
    """A part of the sketch from those of at most MERGED tasks."""
    import pyarrow as pa

    total = np.zeros(PART, np.uint64)
    for data in table.column("counts").to_pylist():
        total += _unpacked(data)
    part, task = (pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("part", "task"))
    return pa.table({"part": part, "task": task, "counts": pa.array([_packed(total)], pa.binary())})


def _merged(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks from rows of part, task, counts. No task merges more than MERGED of them; only the whole comes to the driver."""
    sketch, tasks = np.zeros(2 * COUNTERS, np.uint64), parts.agg(F.max("task")).first()[0] or 0
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / MERGED).cast("int")).groupBy("part", "task").applyInArrow(_summed, "part int, task int, counts binary")
        tasks //= MERGED
        if not tasks:
            break
    for part, _, counts in parts.collect():
        sketch[part * PART : (part + 1) * PART] = _unpacked(counts)
    return np.minimum(sketch, (1 << 32) - 1).astype(np.uint32)


def shared_by(keys: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """About how many sets have each key: the lesser of its counters, less what a counter holds on average."""
    a, b = _counters(keys)
    return np.minimum(sketch[a], sketch[b]).astype(np.int64) - int(sketch.sum(dtype=np.int64) // (2 * COUNTERS))


def least_costly(sketch: np.ndarray, costly: int = COSTLY) -> int:
    """From what estimate on a key is costly: the fuller the sketch, the more its estimates are off, so as not to take rare keys for costly ones."""
    return costly + 6 * math.isqrt(int(sketch.sum(dtype=np.int64)) // (2 * COUNTERS))


def _survey(o: Options):
    """Rows of each text (rid, doc_id, node, n), of counters of keys (part, task, counts), and of bands that need more (band, how)."""
    import pyarrow as pa
    from pyspark import TaskContext

    def rows(**columns):
        n = max(len(v) for v in columns.values())
        kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "node": pa.int64(), "n": pa.int64(), "part": pa.int32(), "task": pa.int32(), "counts": pa.binary(), "band": pa.int32(), "finer": pa.int32(), "deletions": pa.int32()}
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()], names=list(kinds))

    def run(batches):
        task = TaskContext.get().partitionId()
        seen: set[int] = set()
        held, size, sketch = [], 0, np.zeros(2 * COUNTERS, np.uint32)

        def count():
            for at in _counters(np.concatenate(held)):
                np.add.at(sketch, at, np.uint32(1))

        for batch, texts in by_bytes(batches):
            node, n, short = [], [], {}
            for s in shingle_sets(texts, o.words):
                n.append(len(s))
                node.append(class_of(s) if len(s) else None)
                if len(s) and node[-1] not in seen:
                    seen.add(node[-1])
                    for band in bands_of(len(s), o.percent):
                        mine, need = indexed(s, band, (0, 0), o.percent, o.spread, o.thick)
                        if need > 0 and (how := shortage(s, band, o.percent, o.spread, o.thick)):
                            short[(band, *how)] = None
                        held.append(mine)
                        size += len(held[-1])
            yield rows(rid=batch.column("rid"), doc_id=batch.column("doc_id"), node=node, n=n)
            if short:
                yield rows(band=[x[0] for x in short], finer=[x[1] for x in short], deletions=[x[2] for x in short])
            if size > HELD:
                count()
                held, size = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            count()
        for part, counts in enumerate(sketch.reshape(-1, PART)):
            if counts.any():
                yield rows(part=[part], task=[task], counts=[_packed(counts)])

    return run


#: What a row of _index() holds: keys to be compared, noted keys with their costs, or what sets need.
COMPARED, COSTS, NEEDS = range(3)


def _index(o: Options, how: dict[int, tuple[int, int]], sketch, buckets: int):
    """kind, bucket, keys, nodes, extra (bytes) of what a task's sets are indexed under."""
    import pyarrow as pa

    def run(batches):
        costly = least_costly(sketch.value, o.costly)
        seen: set[int] = set()
        keys, nodes, counts, needs, size = [], [], [], [], 0

        def rows():
            k, node = np.concatenate(keys), np.array(nodes, np.int64)
            v = np.repeat(node, counts)
            cost = shared_by(k, sketch.value)
            hot = cost >= costly
            home = (mix(node.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % buckets
            cold = k[~hot]
            five = cold.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # the rest is in the bucket or doesn't matter
            for kind, bucket, columns in (
                (COMPARED, (cold >> np.uint64(40)).astype(np.int64) * buckets >> 24, (five, v[~hot], five[:, :0])),
                (COSTS, np.repeat(home, counts)[hot], (k[hot], v[hot], cost[hot])),
                (NEEDS, home, (np.array(parity, np.int8), node, np.array(needs, np.int64))),
            ):
                batch = blobs(bucket, dict(zip(("keys", "nodes", "extra"), columns, strict=True)))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * batch.num_rows, pa.int32()), *batch.columns], names=["kind", *batch.schema.names])

        parity: list[int] = []
        for _, texts in by_bytes(batches):
            for s in shingle_sets(texts, o.words):
                node = class_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                for band in bands_of(len(s), o.percent):
                    mine, need = indexed(s, band, how.get(band, (0, 0)), o.percent, o.spread, o.thick)
                    keys.append(mine)
                    nodes.append(node)
                    counts.append(len(mine))
                    needs.append(need)
                    parity.append(band & 1)
                    size += len(mine)
            if size > HELD:
                yield from rows()
                keys, nodes, counts, needs, parity, size = [], [], [], [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if keys:
            yield from rows()

    return run


def _shared(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of keys and nodes whose key several nodes have, and how many have it."""

    def groups(k):
        same = k[1:] == k[:-1]
        return np.concatenate([[False], same]) | np.concatenate([same, [False]])

    if not len(key):
        return key, node, key
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    keep = groups(key)  # most keys are a set's alone
    key, node = key[keep], node[keep]
    if not len(key):
        return key, node, key
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[fresh], node[fresh]
    keep = groups(key)
    key, node = key[keep], node[keep]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return key, node, np.repeat(count, count)


def _meet(table):
    """key, node, cost, need: the keys of a bucket that several nodes share, with the nodes; and, without key, what nodes need."""
    import pyarrow as pa

    bucket = table.column("bucket")[0].as_py()
    kind = table.column("kind").to_numpy()
    part = [table.filter(pa.array(kind == k)) for k in (COMPARED, COSTS, NEEDS)]
    five = unblob(part[0], "keys", np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    key, node, cost = _shared(wide.view("<u8")[:, 0].astype(np.int64), unblob(part[0], "nodes", np.int64))
    noted = unblob(part[1], "keys", np.int64)
    parity, owner = unblob(part[2], "keys", np.int8), unblob(part[2], "nodes", np.int64)
    n, m = len(key) + len(noted), len(owner)
    none = lambda size: pa.nulls(size, pa.int64())
    # noted keys are negative, so that no other key is like them
    keys = np.concatenate([key + (bucket << 40), noted | np.int64(-(1 << 63))])
    return pa.Table.from_arrays(
        [
            pa.chunked_array([pa.array(keys), none(m)]),
            pa.array(np.concatenate([node, unblob(part[1], "nodes", np.int64), owner])),
            pa.chunked_array([pa.array(np.concatenate([cost, (1 << 32) + unblob(part[1], "extra", np.int64)])), none(m)]),
            pa.chunked_array([none(n), pa.array(unblob(part[2], "extra", np.int64))]),
            pa.array(np.concatenate([keys & 1, parity.astype(np.int64)])),
        ],
        names=["key", "node", "cost", "need", "parity"],
    )


def _allocated(met: DataFrame) -> DataFrame:
    """key, node: of the keys that a set shares, the cheapest, as many as it needs."""
    shared = met.where("key is not null").select("node", "parity", "key", "cost").distinct()
    needs = met.where("key is null").groupBy("node", "parity").agg(F.max("need").alias("need"))
    w = Window.partitionBy("node", "parity")
    ranked = shared.join(needs, ["node", "parity"]).withColumn("shares", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("cost", "key")))
    return ranked.where("rank <= need + shares").select("key", "node")


def _sets_of(rows: DataFrame, nodes: DataFrame, o: Options) -> DataFrame:
    """node, tokens (sorted hashes as bytes) of the given nodes and a few others."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))

    def run(batches):
        bits, seen = sent.value, set()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                node, tokens = [], []
                for s in shingle_sets(texts[a:b], o.words):
                    if not len(s) or (v := class_of(s)) in seen:
                        continue
                    if in_bitmap(bits, np.array([v], np.int64))[0]:
                        seen.add(v)
                        node.append(v)
                        tokens.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    made = rows.select("text").mapInArrow(run, "node long, tokens binary")
    return stored(made.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared token by token."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                if 100 * len(small) < o.percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= o.percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many tokens fall on each of 4 to 8 times as many bits as there are tokens: sets differ in no fewer tokens than their sketches do in bits."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s ^ _OTHER) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


#: Bytes of sketches that are compared at a time.
COMPARED_BYTES = 4 << 20


def close_pairs(sizes: list[np.ndarray], sketches: list[list[bytes]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the first sets may be similar to which of the second, by their sizes and sketches.

    Sketches stay packed: the bits in which two differ are those of their words' exclusive or.
    """
    found = []
    widths = [np.array([len(x) for x in part]) for part in sketches]
    for w in np.unique(widths[0]):
        for v in (w // 2, w, w * 2):
            i, j = np.flatnonzero(widths[0] == w), np.flatnonzero(widths[1] == v)
            if not len(i) or not len(j):
                continue
            least, sides = int(min(w, v)), []
            for part, at, wide in ((sketches[0], i, w), (sketches[1], j, v)):
                x = np.frombuffer(b"".join(part[k] for k in at), np.uint8).reshape(len(at), wide)
                if wide > least:  # a wide sketch folds into that of half as many bits
                    x = x[:, :least] ^ x[:, least:]
                sides.append(np.pad(x, ((0, 0), (0, -least % 8))).view(np.uint64))
            step = max(1, COMPARED_BYTES // (sides[1].nbytes or 1))
            for at in range(0, len(i), step):
                apart = np.bitwise_count(sides[0][at : at + step, None] ^ sides[1][None]).sum(2, dtype=np.int64)
                n, m = sizes[0][i[at : at + step]][:, None], sizes[1][j][None, :]
                good = (apart * (100 + percent) <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                x, y = np.nonzero(good)
                found.append((i[at + x], j[y]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


#: Members of a list that are compared as a block, about, and blocks of a list at most.
BLOCK, BLOCKS = 128, 4096


def _across(first: DataFrame, labels: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, of all that share a key.

    What shares a key has been compared with the least node that has it, so those that were compared with a node hold
    all such pairs. They are dealt into blocks, and only pairs whose sketches don't exclude them leave a task.
    """
    import pyarrow as pa

    def sketched(batches):
        for batch in batches:
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(t) for t in tokens], pa.int64()), pa.array([sketch(t) for t in tokens], pa.binary())], names=["node", "n", "sketch"])

    def compare(table):
        block, low, high = table.column("block").to_pylist(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        lists = dict(zip(block, table.column("rows").to_pylist(), strict=True))
        left, right = lists.get(low, []), lists.get(high, [])
        sizes = [np.array([r["n"] for r in part], np.int64) for part in (left, right)]
        i, j = close_pairs(sizes, [[r["sketch"] for r in part] for part in (left, right)], o.percent)
        (x, p), (y, q) = ((np.array([r["node"] for r in part], np.int64)[k], np.array([r["label"] for r in part], np.int64)[k]) for part, k in ((left, i), (right, j)))
        x, y = x[p != q], y[p != q]
        both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    members = first.select("a", F.col("b").alias("node")).unionByName(first.select("a", F.col("a").alias("node")).distinct())
    named = stored(members.join(labels, "node", "left").select("a", "node", F.coalesce("label", "node").alias("label")), "members")
    lists = named.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and size > 2")
    parted = stored(lists.select("a", F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("size") / BLOCK))).cast("int").alias("blocks")), "parted")
    known = stored(sets.mapInArrow(sketched, "node long, n long, sketch binary"), "sketches")
    dealt = named.join(parted, "a").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(known, "node")
    # a block goes to each other one as one row
    packed = dealt.groupBy("a", "blocks", "block").agg(F.collect_list(F.struct("node", "label", "n", "sketch")).alias("rows"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("a", "block", "rows", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.groupBy("a", "low", "high").applyInArrow(compare, "a long, b long").distinct()


class Candidates(NamedTuple):
    rows: DataFrame  # rid, doc_id, node, n: node names the set, n is its size
    first: DataFrame  # pairs (a, b) of nodes that share a key of which a is the least node
    sets: DataFrame  # node, tokens


def _candidates(docs: DataFrame, o: Options) -> Candidates:
    rows = with_row_id(texts_of(docs))
    survey = stored(rows.mapInArrow(_survey(o), "rid long, doc_id long, node long, n long, part int, task int, counts binary, band int, finer int, deletions int"), "survey")
    known = survey.where("rid is not null").select("rid", "doc_id", "node", "n")
    how = {r[0]: (r[1], r[2]) for r in survey.where("band is not null").groupBy("band").agg(F.max("finer"), F.max("deletions")).collect()}  # a row per band
    sketch = _merged(survey.where("part is not null").select("part", "task", "counts"))
    tokens = known.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 24, max(LEAST_BUCKETS, tokens // BUCKET_KEYS))
    sent = docs.sparkSession.sparkContext.broadcast(sketch)  # 8 MB
    entries = rows.select("text").mapInArrow(_index(o, how, sent, buckets), "kind int, bucket long, keys binary, nodes binary, extra binary")
    met = stored(entries.groupBy("bucket").applyInArrow(_meet, "key long, node long, cost long, need long, parity long"), "met")
    shared = stored(_allocated(met), "shared")

    least = stored(shared.groupBy("key").agg(F.min("node").alias("a")), "least")
    first = stored(shared.join(least, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    several = shared.join(least, "key").where("node <> a")
    sets = _sets_of(rows, stored(several.select("node").unionByName(several.select(F.col("a").alias("node"))).distinct(), "nodes"), o)
    return Candidates(known, first, sets)


def similar_groups(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, rid, kept (one row of each component).

    Texts link when 100 * (size of the intersection) >= percent * (size of the union) of their shingle sets; component_id
    is the least doc_id that links reach, the row's own included. A null or empty text, or one of white space, has no
    shingle and links with nothing, not even its like. Repeated rows have equal sets and link. A null doc_id counts as
    larger than any other, so that component_id is null only if all of a component are. An empty table gives an empty
    table. Columns other than doc_id and text are ignored, whatever their names.
    """
    o = options
    known, first, sets = _candidates(docs, o)
    links = stored(_verified(first, sets, o), "links")
    labels = components(links)

    pairs = _across(first, labels, sets, o)
    more = stored(_verified(pairs.join(first, ["a", "b"], "left_anti"), sets, o), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    placed = stored(known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    names = stored(placed.where("label is not null").groupBy("label").agg(first), "names")
    alone = F.col("label").isNull()
    return placed.join(names, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "rid", (alone | (F.col("rid") == F.col("first.rid"))).alias("kept")
    )


def similar_links(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Every link between different sets once: doc_a, doc_b, rid_a, rid_b, rid_a < rid_b.

    Rows with equal sets link as in similar_groups(); one of them, with the least doc_id and then rid, stands for all.
    Members of a list are all compared with each other here, also within a component.
    """
    o = options
    known, first, sets = _candidates(docs, o)
    alone = first.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)  # each node is its own component
    links = _verified(first.unionByName(_across(first, alone, sets, o)).distinct(), sets, o)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("r")
    names = stored(known.where("node is not null").groupBy("node").agg(least).select("node", "r.doc_id", "r.rid"), "names")
    side = lambda k: names.select(F.col("node").alias(k), F.struct("rid", "doc_id").alias(f"r{k}"))
    both = links.join(side("a"), "a").join(side("b"), "b").select(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
    return both.select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"), F.col("x.rid").alias("rid_a"), F.col("y.rid").alias("rid_b"))
