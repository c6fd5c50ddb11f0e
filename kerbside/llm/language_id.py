"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled rows, then
calibrated with one temperature. Letters are lower-cased and everything else counts as a space; n-grams of two and
three characters are hashed. A text's term frequencies are relative to its number of n-grams.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import by_bytes, chunks, small_batches, texts_of, unused, utf8

FEATURES = 1 << 16

#: Labelled rows that training takes at most of a language, of all languages together (but one of each at least), and
#: different n-grams that such a row may have. Weights that training holds; with very many languages n-grams share features.
SAMPLE_ROWS, ALL_ROWS, SAMPLE_GRAMS, WEIGHTS = 1000, 16_000, 8192, 1 << 25

#: Columns of a prediction, and what is predicted of a text with letters where there is nothing to learn from.
NAMES, UNKNOWN = ("lang_pred", "score"), "unknown"

_SCALE = 64.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # features x languages, with the inverse document frequencies
    bias: np.ndarray
    temperature: float


@cache
def _letters() -> np.ndarray:
    """For each code point: its small letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(texts: list[bytes], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other, how many each has, and whether it has a letter."""
    points = np.frombuffer("\0".join(["", *(t.decode() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = _letters()[points]
    ends = np.cumsum([0] + [len(t.decode()) + 1 for t in texts])  # each text begins after its separator
    letter = mapped != 32
    before = np.concatenate([[0], np.cumsum(letter)])
    has = before[ends[1:]] > before[ends[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space after a letter
    keep[ends] = True
    c = mapped[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])[ends]  # of the separators
    two = c[:-1] * _A + c[1:] * _B
    three = two[:-1] + c[2:] * _C
    shift, mask = np.uint64(40), np.uint64(features - 1)
    two = ((two ^ two >> np.uint64(29)) * _C >> shift & mask).astype(np.int64)
    three = ((three ^ three >> np.uint64(31)) * _A >> shift & mask).astype(np.int64)
    # at position i: the pair and the triple that begin there; a text's run from its separator up to the next
    pairs = np.empty(2 * len(two), np.int64)
    pairs[0::2] = two
    pairs[1 : 2 * len(three) : 2] = three
    if len(pairs):
        pairs[-1] = 0
    return pairs[2 * at[0] : 2 * at[-1]], 2 * np.diff(at), has


def _counts(features: int):
    """order, lang, distinct n-grams and their counts of each text; a text has at most so many features."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                grams, lens, _ = ngrams(texts[a:b], features)
                made = [np.unique(part, return_counts=True) for part in np.split(grams, np.cumsum(lens)[:-1])]
                part = batch.slice(a, b - a)
                ids, counts = (pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("lang"), ids, counts], names=["order", "lang", "ids", "counts"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int = FEATURES, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. rows: features, values, class."""
    z, n, bz, bn = np.zeros((features, classes)), np.zeros((features, classes)), np.zeros(classes), np.zeros(classes)

    def solved(z, n, l1):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, x, y = rows[r]
            w, b = solved(z[ids], n[ids], l1), solved(bz, bn, 0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            for g, zz, nn, ww, at in ((x[:, None] * p, z, n, w, ids), (p, bz, bn, b, slice(None))):
                zz[at] += g - (np.sqrt(nn[at] + g * g) - np.sqrt(nn[at])) / alpha * ww
                nn[at] += g * g
    return solved(z, n, l1), solved(bz, bn, 0)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the labels of rows not trained on likeliest."""
    best, doubt = (np.inf, 1.0), 1 / (len(y) + 1)  # of any label, or few rows without a mistake would make all sure
    for t in np.exp(np.linspace(-3, 3, 121)):
        s = scores / t
        m = s.max(1, keepdims=True)
        total = np.log(np.exp(s - m).sum(1)) + m[:, 0]
        loss = (total - (1 - doubt) * s[np.arange(len(y)), y] - doubt * s.mean(1)).mean() if len(y) else 0
        best = min(best, (loss, t))
    return float(best[1])


def train(docs: DataFrame, may_learn=None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from text and lang of the rows that may be learnt from; None if there are none.

    At most sample_rows rows of each language and about ALL_ROWS of all are taken, those with the least hash of doc_id
    and lang; their whole texts count, and one with more than SAMPLE_GRAMS different n-grams is not taken. Every fifth
    of them only calibrates. Every language of the ALL_ROWS commonest is learnt of which such a row is left. Rows without lang, with lang und
    (which names no language) or without a letter are left out.
    """
    rows = texts_of(docs, F.col("lang").cast("string")).where("lang <> 'und' and text rlike '\\\\p{L}'")
    if may_learn is not None:
        rows = rows.where(may_learn)
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(ALL_ROWS).collect()
    if not sizes:
        return None
    each = max(1, min(sample_rows, ALL_ROWS // len(sizes)))
    features = min(FEATURES, max(1 << 10, 1 << (WEIGHTS // len(sizes)).bit_length() - 1))
    # about twice as many candidates of each language, then the first of them
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * each / n) * 2 - 1) for lang, n in sizes], "lang string, share double")
    picked = rows.withColumn("order", F.xxhash64("doc_id", "lang")).join(F.broadcast(shares), "lang")  # bounded by ALL_ROWS
    picked = picked.where(F.col("order") <= F.col("share") * float(1 << 63))
    counted = picked.select("order", "lang", "text").mapInArrow(_counts(features), "order long, lang string, ids array<int>, counts array<int>")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "ids"))
    sample = counted.where(F.size("ids") <= SAMPLE_GRAMS).withColumn("nth", first).where(F.col("nth") <= each).orderBy("order", "lang", "nth").collect()
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    df = np.zeros(features)
    for r in sample:
        df[r["ids"]] += 1
    idf = np.log((1 + len(sample)) / (1 + df)) + 1
    made = []
    for r in sample:
        ids, counts = np.array(r["ids"]), np.array(r["counts"], np.float64)
        made.append((ids, counts / counts.sum() * idf[ids] * _SCALE, languages.index(r["lang"])))
    kept = [m for i, m in enumerate(made) if i % 5 or len(made) < 20]
    rest = [m for i, m in enumerate(made) if not i % 5]
    weights, bias = ftrl(kept, len(languages), features)
    scores = np.array([x @ weights[ids] + bias for ids, x, _ in rest])
    return Model(languages, (weights * idf[:, None] * _SCALE).astype(np.float32), bias, temperature(scores, np.array([y for _, _, y in rest])))


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, names: tuple[str, str] = NAMES, unnamed: str = "und") -> DataFrame:
    """doc_id (or the columns named in keep), lang_pred, score (or other names) for every whole text.

    A text that is null or has no letter is und with score 0. If there is no model, every other text is what unnamed
    says, with score 0. Repeated rows are each predicted; other columns are ignored whatever their names unless kept.
    """
    import pyarrow as pa

    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by features x languages
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    taken = set(names) & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} can't be kept")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep) + "`{}` string, `{}` double".format(*names)

    def run(batches):
        m = sent.value
        for batch, part in by_bytes(batches):
            grams, lens, has = ngrams(part, FEATURES if m is None else len(m.weights))
            pred, score = [unnamed if h else "und" for h in has], np.zeros(len(part))
            if m is not None:
                ends = np.cumsum(lens)
                sums = np.zeros((len(part), len(m.languages)))
                for i in range(len(m.languages)):
                    run_ = np.concatenate([[0.0], np.cumsum(m.weights[:, i][grams], dtype=np.float64)])
                    sums[:, i] = run_[ends] - run_[ends - lens]
                s = (sums / np.maximum(lens, 1)[:, None] + m.bias) / m.temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                pred = [m.languages[k] if h else "und" for k, h in zip(best, has, strict=True)]
                score = np.where(has, p[np.arange(len(part)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose prediction isn't und: those whose text has a letter.

    Every text with a letter is predicted to be in some language that the model knows, or in an unknown one if there is
    no model, and stays however low its score. The prediction's columns have names that docs doesn't.
    """
    names = [unused(docs, name) for name in NAMES]
    return predict(docs, model, docs.columns, tuple(names), UNKNOWN).where(F.col(names[0]) != "und").drop(*names)
