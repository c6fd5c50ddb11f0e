"""Ranked lexical search of all documents for each of a set of items, through tiers of postings by impact.

A posting is a term of a document with its impact: what the term's occurrences there, and the document's length, make
of the term's weight. Each tier holds, of each term, its postings of the highest impacts, and whatever the tiers before it
hold; the last tier holds all. Beside a tier stands, for each term, the residual bound: the highest impact that the tier
leaves out. An item is settled at a tier if what its terms' residual bounds add up to is under the score that 50
documents reach there: then no document that the tier lacks can be among the best, and of those it has only the ones that
could still reach that score are scored from all of their postings. Items without that proof fall through to the next
tier; in the last one all bounds are 0.

Tiers are kept by document, so that a task scores a block of documents for all open items at once, as a product of two
matrices of integers below 2 ** 53 in double precision, which is exact. Items come in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.llm.common import by_bytes, small_batches, stored, texts_of, utf8

#: Of each tier but the last: postings that a term has there at most, as a number and as a share of all it has; the larger holds.
TIERS = ((1_000, 1 / 64), (8_000, 1 / 8))
#: Levels of impact by which postings are counted, and the highest impact.
LEVELS, IMPACT = 32, 1_000_000
#: Items of a block at most, terms times items of a block (but for a single item), and numbers of a matrix of documents.
BLOCK_ITEMS, BLOCK_CELLS, MATRIX = 1_024, 1 << 22, 1 << 20
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

#: Letters and digits, and all bytes of other letters and signs than ASCII's; A to Z become small, the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list per piece of it."""
    low, at = text.translate(_TERM_BYTES), 0
    while at < len(low):
        end = len(low) if len(low) - at <= PIECE else low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def _lists(values: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32)))


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text, with repeats), terms (places in the given list) and tfs of every row of docs."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches):
        place = sent.value.get
        for batch, texts in by_bytes(batches):
            counts, ids, tfs = [], [], []
            for text in texts:
                n, found = 0, []
                for words in terms_of(text):
                    n += len(words)
                    found += [i for w in words if (i := place(w)) is not None]
                at, tf = np.unique(np.array(found, np.int32), return_counts=True)
                counts.append(n)
                ids.append(at)
                tfs.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), _lists(ids), _lists(tfs)], names=["doc_id", "n", "terms", "tfs"])

    return texts_of(docs).mapInArrow(run, POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Of postings: tf, and n of their documents. n_docs: documents with a term; length: all their terms."""
    m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // max(length, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Index:
    """rows: rid, doc_id, n, terms, tfs of all documents; tiers: tables of rid, terms, impacts, the last but one first left out.

    weights: of each term; bounds: for each tier but the last, the residual bound of each term's impact.
    """

    terms: list[bytes]
    rows: DataFrame
    n_docs: int
    length: int
    weights: np.ndarray
    tiers: list[DataFrame]
    bounds: list[np.ndarray]


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of rows with lists: which row each term is of, and the term."""
    lists = batch.column("terms")
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), lists.values.to_numpy()[offsets[0] : offsets[-1]]


def _values(batch, name: str) -> np.ndarray:
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]]


def build_index(docs: DataFrame, terms: list[bytes], tiers=TIERS) -> Index:
    """The tiers of all documents for the given terms. A row without doc_id, or with one that others have, is a document of its own."""
    import pyarrow as pa

    rows = stored(postings(docs, terms).withColumn("rid", F.monotonically_increasing_id()), "postings")
    n_docs, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(terms)

    def impact_of(batch):
        row, term = _flat(batch)
        return row, term, impacts(_values(batch, "tfs"), batch.column("n").to_numpy()[row], n_docs, length)

    def levels(batches):
        counts, tops = np.zeros(size * LEVELS, np.int64), np.zeros(size * LEVELS, np.int64)
        for batch in batches:
            _, term, impact = impact_of(batch)
            at = term.astype(np.int64) * LEVELS + impact * LEVELS // (IMPACT + 1)
            counts += np.bincount(at, minlength=len(counts))
            np.maximum.at(tops, at, impact)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(tops[some])], names=["at", "n", "top"])

    counts, tops = np.zeros(size * LEVELS, np.int64), np.zeros(size * LEVELS, np.int64)
    for at, n, top in rows.select("n", "terms", "tfs").mapInArrow(levels, "at long, n long, top long").groupBy("at").agg(F.sum("n"), F.max("top")).collect():
        counts[at], tops[at] = n, top
    counts, tops = counts.reshape(size, LEVELS), tops.reshape(size, LEVELS)
    df = counts.sum(1)
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    above = counts[:, ::-1].cumsum(1)[:, ::-1]  # postings of a level and of those over it
    below = np.concatenate([np.zeros((size, 1), np.int64), np.maximum.accumulate(tops, 1)], 1)  # the highest impact under a level
    made, bounds = [], []
    for most, share in tiers:
        lowest = (above > np.maximum(most, df * share)[:, None]).sum(1)  # of the levels that a term has here
        bounds.append(below[np.arange(size), lowest])
        sent = docs.sparkSession.sparkContext.broadcast(lowest)

        def high(batches, sent=sent):
            for batch in batches:
                row, term, impact = impact_of(batch)
                stays = impact * LEVELS // (IMPACT + 1) >= sent.value[term]
                row, term, impact = row[stays], term[stays], impact[stays]
                at, first = np.unique(row, return_index=True)
                offsets = pa.array(np.append(first, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(impact.astype(np.int32)))], names=["rid", "terms", "impacts"])

        made.append(stored(rows.select("rid", "n", "terms", "tfs").mapInArrow(high, "rid long, terms array<int>, impacts array<int>"), "tier"))
    return Index(terms, rows, n_docs, length, weights, made, bounds)


class _Open:
    """Open items as a matrix: terms that any of them has, by items."""

    def __init__(self, index: Index, items: list[np.ndarray], which: list[int]):
        self.which = np.array(which, np.int64)
        used = np.unique(np.concatenate([items[i] for i in which]))
        self.column = np.full(len(index.terms), -1, np.int64)
        self.column[used] = np.arange(len(used))
        # sums of products stay under 2 ** 53, and so exact, unless an item has more terms than texts have
        exact = max(len(items[i]) for i in which) * max(1, int(index.weights.max(initial=1))) * IMPACT < 1 << 53
        self.matrix = np.zeros((len(used), len(which)), np.float64 if exact else np.int64)
        for k, i in enumerate(which):
            self.matrix[self.column[items[i]], k] = index.weights[items[i]]

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of documents by items) of successive documents; rows of postings ascend."""
        column = self.column[term]
        row, column, impact = row[column >= 0], column[column >= 0], impact[column >= 0]
        step = max(1, MATRIX // max(1, len(self.matrix)))
        for a in range(0, rows, step):
            b = min(rows, a + step)
            i, j = np.searchsorted(row, [a, b])
            x = np.zeros((b - a, len(self.matrix)), self.matrix.dtype)
            x[row[i:j] - a, column[i:j]] = impact[i:j]
            yield a, (x @ self.matrix).astype(np.int64)


def _reached(tier: DataFrame, items: _Open, k: int) -> DataFrame:
    """item (place among the open ones), score: of each task's documents, the k highest scores by what the tier has."""
    import pyarrow as pa

    sent = tier.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        open_ = sent.value
        best = np.zeros((k, len(open_.which)), np.int64)
        for batch in batches:
            row, term = _flat(batch)
            for _, scores in open_.scores(row, term, _values(batch, "impacts"), batch.num_rows):
                both = np.concatenate([best, scores])
                best = np.partition(both, len(both) - k, axis=0)[-k:]
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[at, item])], names=["item", "score"])

    return tier.select("terms", "impacts").mapInArrow(run, "item long, score long")


#: Parts in which an item's rows are ranked first, so that what all tasks tell of it doesn't meet in one.
PARTS = 32


def _ranked(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of each item, with rank."""
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.drop("part")


def _least(reached: DataFrame, items: int, k: int) -> np.ndarray:
    """Of each item, the k-th highest score, 0 if there are fewer."""
    ranked = _ranked(reached.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), [F.desc("score")], k)
    out = np.zeros(items, np.int64)
    for item, score in ranked.where(F.col("rank") == k).select("item", "score").collect():
        out[item] = score
    return out


def _candidates(tier: DataFrame, items: _Open, bound: np.ndarray, rest: np.ndarray, least: np.ndarray) -> DataFrame:
    """rid, item: the tier's documents that may reach an item's least score. bound: of each term; rest: what an item's bounds add up to."""
    import pyarrow as pa

    sent = tier.sparkSession.sparkContext.broadcast((items, bound, rest, np.maximum(least, 1)))

    def run(batches):
        open_, bound, rest, least = sent.value
        for batch in batches:
            row, term = _flat(batch)
            rid = batch.column("rid").to_numpy()
            for a, gain in open_.scores(row, term, _values(batch, "impacts") - bound[term], batch.num_rows):
                at, item = np.nonzero(gain + rest >= least)
                yield pa.RecordBatch.from_arrays([pa.array(rid[a + at]), pa.array(open_.which[item])], names=["rid", "item"])

    return tier.mapInArrow(run, "rid long, item long")


SCORED = "item long, doc_id long, rid long, score long"


def _scored(index: Index, items: list[np.ndarray], candidates: DataFrame) -> DataFrame:
    """SCORED of candidates (rid, item), from all postings of their documents."""
    import pyarrow as pa

    sent = index.rows.sparkSession.sparkContext.broadcast((_Open(index, items, list(range(len(items)))), index.n_docs, index.length))

    def run(batches):
        open_, n_docs, length = sent.value
        for batch in batches:
            row, term = _flat(batch)
            impact = impacts(_values(batch, "tfs"), batch.column("n").to_numpy()[row], n_docs, length)
            wanted, owner = _values(batch, "items"), np.repeat(np.arange(batch.num_rows), np.diff(batch.column("items").offsets.to_numpy()))
            for a, scores in open_.scores(row, term, impact, batch.num_rows):
                i, j = np.searchsorted(owner, [a, a + len(scores)])
                docs = owner[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(wanted[i:j]), batch.column("doc_id").take(pa.array(docs)), batch.column("rid").take(pa.array(docs)), pa.array(scores[docs - a, wanted[i:j]])], names=["item", "doc_id", "rid", "score"])

    asked = candidates.groupBy("rid").agg(F.collect_list("item").alias("items"))
    return index.rows.join(asked, "rid").select("rid", "doc_id", "n", "terms", "tfs", "items").mapInArrow(run, SCORED)


def _best(index: Index, items: _Open, least: np.ndarray, k: int) -> DataFrame:
    """SCORED of each task's k best documents of each item that reach its least score, from all postings."""
    import pyarrow as pa

    sent = index.rows.sparkSession.sparkContext.broadcast((items, np.maximum(least, 1), index.n_docs, index.length))

    def run(batches):
        open_, least, n_docs, length = sent.value
        least, held, sizes = least.copy(), [[] for _ in open_.which], [0] * len(open_.which)

        def cut(i):
            """Keeps the k best: by score, then by doc_id (null first), then by row."""
            score, doc, none, rid = (np.concatenate(c) for c in zip(*held[i], strict=True))
            order = np.lexsort([rid, doc, ~none, -score])[:k]
            held[i], sizes[i] = [(score[order], doc[order], none[order], rid[order])], len(order)
            if len(order) == k:
                least[i] = score[order[-1]]

        for batch in batches:
            row, term = _flat(batch)
            impact = impacts(_values(batch, "tfs"), batch.column("n").to_numpy()[row], n_docs, length)
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc, rid = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("rid").to_numpy()
            for a, scores in open_.scores(row, term, impact, batch.num_rows):
                item, at = np.nonzero((scores >= least).T)
                some, first = np.unique(item, return_index=True)
                for i, p, q in zip(some.tolist(), first.tolist(), np.append(first, len(item))[1:].tolist(), strict=True):
                    docs = at[p:q]
                    held[i].append((scores[docs, i], doc[a + docs], none[a + docs], rid[a + docs]))
                    sizes[i] += len(docs)
                    if sizes[i] > 4 * k:
                        cut(i)
        for i, parts in enumerate(held):
            if parts:
                cut(i)
                score, doc, none, rid = held[i][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), open_.which[i])), pa.array(doc, mask=none), pa.array(rid), pa.array(score)], names=["item", "doc_id", "rid", "score"])

    return index.rows.mapInArrow(run, SCORED)


def search_terms(index: Index, items: list[np.ndarray], k: int = 50) -> DataFrame:
    """item (its place in the list), rank, doc_id, score, tier of the k best documents of each item, given as places of different terms.

    Documents without any of the terms aren't told. Equal scores ascend by doc_id, null first; rows with the same doc_id in
    any order. tier: at which the item was settled, from 1.
    """
    which, least, parts = [i for i, t in enumerate(items) if len(t)], np.zeros(len(items), np.int64), []
    for number, (tier, bound) in enumerate(zip(index.tiers, index.bounds, strict=True), 1):
        if not which:
            break
        rest = np.array([int((index.weights[items[i]] * bound[items[i]]).sum()) for i in which])
        open_ = _Open(index, items, which)
        least[which] = np.maximum(least[which], _least(_reached(tier, open_, k), len(which), k))
        proved = (rest < least[which]) | (rest == 0)
        settled = [i for i, p in zip(which, proved, strict=True) if p]
        if settled:
            found = _candidates(tier, _Open(index, items, settled), bound, rest[proved], least[settled])
            parts.append(_scored(index, items, found).withColumn("tier", F.lit(number)))
        which = [i for i, p in zip(which, proved, strict=True) if not p]
    if which:
        parts.append(_best(index, _Open(index, items, which), least[which], k).withColumn("tier", F.lit(len(index.tiers) + 1)))
    spark = index.rows.sparkSession
    scored = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCORED + ", tier int")
    parted = scored.where("score > 0").withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(PARTS)))
    return _ranked(parted, [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("rid")], k).select("item", "rank", "doc_id", "score", "tier")


def _item_blocks(items: DataFrame, item_id: str) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Ids and terms of successive items, so many that their matrix stays small."""
    small_batches(items.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted({w for words in terms_of(t) for w in words}) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    ids, found, terms = [], [], set()
    for row in items.select(F.col(item_id).alias("item"), F.col("text").cast("string")).mapInArrow(run, f"item {kind}, terms array<binary>").toLocalIterator():
        own = {bytes(t) for t in row.terms or ()}
        if ids and (len(ids) == BLOCK_ITEMS or len(terms | own) * (len(ids) + 1) > BLOCK_CELLS):
            yield ids, found
            ids, found, terms = [], [], set()
        ids.append(row.item)
        found.append(own)
        terms |= own
    if ids:
        yield ids, found


def search(docs: DataFrame, items: DataFrame, k: int = 50, tiers=TIERS, item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score, tier: the k best of all docs (doc_id, text) for each row of items (item_id, text).

    Terms are runs of letters, digits and characters other than ASCII, with A to Z in lower case. A null or empty text has
    none: such an item finds nothing, such a document isn't found. Rows that repeat an item are answered each; of
    documents that are repeated each counts and is found. Items are taken in blocks, each of which reads docs once, whatever
    other columns these have.
    """
    spark: SparkSession = docs.sparkSession
    out, kind = [], items.schema[item_id].dataType.simpleString()
    for ids, found in _item_blocks(items, item_id):
        terms = sorted(set().union(*found))
        place = {t: i for i, t in enumerate(terms)}
        index = build_index(docs, terms, tiers)
        ranked = search_terms(index, [np.array(sorted(place[t] for t in own), np.int64) for own in found], k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, `{item_id}` {kind}")  # no more than BLOCK_ITEMS
        out.append(ranked.join(F.broadcast(names), "item").select(item_id, "rank", "doc_id", "score", "tier"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"`{item_id}` {kind}, rank int, doc_id long, score long, tier int")
