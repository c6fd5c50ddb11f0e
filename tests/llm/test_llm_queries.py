"""The registered queries over small tables: empty, and with nulls, repeated rows, ties and clashing columns."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from kerbside.llm.exact_dedup import exact_duplicates
from kerbside.llm import queries as Q
from kerbside.llm.common import stored, texts_of, with_row_id, without
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, _rid long, score double, lang_pred string, places string, kept boolean"
TEXTS = [None, "", " \n", "one two three four five six seven", "You are a stupid idiot. " * 8, "write to someone@example.com or call +1 (555) 555-0199 " * 3, "some quiet words " * 40, "日本語 é", "x" * 30000]


def write(spark, path, rows):
    def put(name, rows, kind):
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")

    put("documents", rows, DOCS)
    put("labels", [(r[0], int("idiot" in (r[1] or "")), "z") for r in rows[::2]], "doc_id long, toxic int, text string")
    vectors = [(i, v) for i, v in enumerate([[1.0, 2.0], None, [0.0, 0.0], [float("nan"), 1.0], [3.0, 1.0], [3.0, 1.0], [1.0], [-2.0, 0.5]])] if rows else []
    put("embeddings", [(i * 20, v, 1) for i, v in vectors] + [(None, v, 1) for _, v in vectors[:1]], "vec_id long, embedding array<double>, rid int")
    put("benchmark", [(1, "Quiet stupid words", 0), (1, "Quiet stupid words", 0), (2, None, 0), (3, "", 0), (None, "seven é", 0)] if rows else [], "item_id long, text string, doc_id int")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    tail = ("en", "s", 1, 7, 7, 0.5, "x", "y", True)
    rows = [(i, t, *tail) for i, t in enumerate(TEXTS * 2)] + [(3, TEXTS[3], *tail)] * 2 + [(None, TEXTS[6], *[None] * 9), (None, None, *[None] * 9)]
    return write(spark, tmp_path_factory.mktemp("odd"), rows), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_odd_tables(spark, odd, name):
    path, rows = odd
    got = Q.queries()[name](spark, path).collect()
    ids = sorted(str(r[0]) for r in rows)
    if name == "op5_rotated_codes":
        assert {r.query_id for r in got} == {0, 80, 100, 140} and all(0 <= r["rank"] - 1 < 4 for r in got)
        # [1, 2] is there twice, once without an id, and comes right after itself for its equal
        assert sum(r.vec_id is None for r in got) == 4 and [r.vec_id for r in got if r.query_id == 80 and r["rank"] > 2] == [None, 140]
        return
    if name == "op11_tiered_search":
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
        # both rows of the item are answered; three rows hold "quiet words", one of them without an id, two are insults
        assert set(found) == {1, None} and sorted(d for _, d, _ in found[1] if d is not None) == sorted([4, 13, 6, 15] * 2) and [n for n, *_ in found[1]] == sorted([*range(1, 6)] * 2)
        assert sorted(d for _, d, _ in found[None]) == [3, 3, 3, 7, 12, 16] and all(a[2] >= b[2] > 0 for f in found.values() for a, b in zip(f, f[1:], strict=False))
        return
    if name == "op8_best_fit_packing":
        assert sorted(str(r.doc_id) for r in got if r.piece == 0) == ids
        return
    assert sorted(str(r.doc_id) for r in got) == ids
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            continue
        t = text[r.doc_id]
        if name in ("op1_toxicity", "op2_language_id"):
            five, left = (5, 0) if name == "op1_toxicity" else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % five == left) and 0 <= r.score <= 1
        if name == "op9_exact_dedup":
            same = [d for d, x in text.items() if x == t]
            assert r.keep_id == max(same) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if name == "op6_jaccard_join":
            assert r.component_id == (min(d for d, x in text.items() if x == t) if t.split() else r.doc_id)
        if name == "op4_substring_dedup":
            assert r.n_words == len(t.split()) and r.n_removed == (len(t.split()) if len(t.split()) >= 35 else 0)


def test_pipeline_of_odd_tables(spark, odd):
    path, rows = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, path), "stage")
        assert docs.columns == columns
    # of equal texts the largest doc_id stays, of near ones the least; "x" * 30000 is a word like any other
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [12, 13, 14, 15, 16, 17]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).where("piece = 0").count() == 6


def test_row_ids_do_not_depend_on_how_files_are_read(spark, tmp_path):
    path = f"{tmp_path}/with space.parquet"
    spark.range(2000).selectExpr("id doc_id", "repeat('a word ', 9) text", "id rid").repartition(5).write.parquet(path)
    docs, seen = spark.read.parquet(path), []
    for parts, size in ((4, "128m"), (32, "4k")):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({(r.rid, r.doc_id) for r in with_row_id(texts_of(docs)).collect()})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({r for r, _ in seen[0]}) == 2000
    gone = stored(with_row_id(texts_of(docs)).where("doc_id % 3 = 0").select("rid"), "gone")
    left = without(docs, gone)
    assert left.columns == docs.columns and {r.rid for r in left.collect()} == {i for i in range(2000) if i % 3}
    assert with_row_id(spark.range(9).toDF("doc_id")).select("rid").distinct().count() == 9  # no table of files


def test_row_ids_of_derived_tables(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(10).selectExpr("id doc_id", "concat('text ', id) text").write.parquet(path)
    docs = spark.read.parquet(path)
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = docs.join(twice.select(F.col("doc_id").alias("other"), "copy"), F.col("other") == F.col("doc_id"))
    for derived in (twice, joined, docs.union(docs)):
        assert {(r.rid, 1) for r in with_row_id(derived).collect()} == {(r.rid, r["count"]) for r in with_row_id(derived).groupBy("rid").count().collect()}
        found = exact_duplicates(derived).collect()
        assert len(found) == 20 and len({r.rid for r in found}) == 20
        assert sum(r.kept for r in found) == 10 and all(r.group_size == 2 for r in found)
