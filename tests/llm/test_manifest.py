import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from kerbside.llm import manifest as M
from kerbside.llm import queries as Q
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, path string, digest int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text=...):
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*map(say, (r[0], r[3], r[2], r[4], r[1] if text is ... else text)))


def tree(digests):
    """The top, and each leaf's path."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            run = digests[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        digests = [h(*digests[k : k + 16]) for k in range(0, len(digests), 16)]
    return digests[0], paths


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of all rows, one after the other."""
    sources = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf_of(r) for r in sources[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for r, path in zip(sources[s], trees[s][1], strict=True):
            path = path + above
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            end = leaf_of(r, text)
            for a, b in path:
                end = h(a, end, b)
            out.append((r[0], leaf_of(r), trees[s][0], root, h(*(a + b for a, b in path)), end, end == root))
    return out


def rows_of(sizes, seed=0):
    rng = random.Random(seed)
    out = []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "Some Text", "small é", "x" * 5000, f"Row {i}"])
            out.append((rng.randrange(10**6), text, rng.choice(["en", None]), source, rng.choice([None, len(text or "")]), "c", "c", "c", 1))
    out += [(None, "No Id", None, None, None, None, None, None, None)] * 3 + out[:3]
    rng.shuffle(out)
    return out


SIZES = [{"a": 1}, {None: 1, "": 1, "b": 16, "é": 17, "z": 255, "y": 256, "x": 257, "hot": 5000}, {f"s{i}": 1 + i % 3 for i in range(300)}]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("parts", [1, 7])
def test_as_one_tree_after_the_other(spark, tmp_path, monkeypatch, sizes, parts):
    monkeypatch.setattr(M, "MOST_ROWS", 1 + len(sizes) * 20 if parts == 1 else 10**6)
    monkeypatch.setattr(M, "LEAST_ROWS", 3)
    rows = rows_of(sizes)
    spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_merkle_manifest(spark, str(tmp_path)).collect()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(manifest(rows), key=key)


def test_sql(spark, tmp_path):
    rows = rows_of({"a": 40, None: 3, "": 2, "b": 300})
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda t: tuple(map(str, t))
    assert sorted(con.sql(Q.oracle_sql()["op13_merkle_manifest"]).fetchall(), key=key) == sorted(manifest(rows), key=key)


@pytest.mark.parametrize("split", [1, 2, 3, 5, 8])
def test_subtrees_wherever_tasks_begin(split):
    """Pieces of sorted leaves, cut and ordered in any way: all nodes of a run come from one piece, or are ragged."""
    import pyarrow as pa

    rng = random.Random(split)
    rows, at = [], 0
    for g, n in (("a", 700), ("b", 1), ("c", 300), ("d", 16)):
        rows += [(g, 0, at + i, i, bytes([i % 256]) * 32) for i in range(n)]
        at += n
    cuts = sorted(rng.sample(range(1, len(rows)), split - 1))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    tasks = [[], []]
    for i, p in enumerate(pieces):
        tasks[i % 2].append(p)
    nodes = {}
    for task in tasks:
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*p, strict=True)], names=["g", "part", "row", "pos", "digest"]) for p in task]
        for b in M._subtrees(batches):
            for g, level, idx, digest, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                assert (g, level, idx) not in nodes
                nodes[g, level, idx] = digest.hex(), kind
    for g, n in (("a", 700), ("b", 1), ("c", 300), ("d", 16)):
        level = [(bytes([i % 256]) * 32).hex() for i in range(n)]
        for k in range(4):
            for i, d in enumerate(level):
                if (g, k, i) in nodes:
                    assert nodes[g, k, i][0] == d and (nodes[g, k, i][1] != M._TOP or len(level) == 1)
            if len(level) == 1:
                break
            level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    if split == 1:  # the last tree's end isn't seen
        assert {(g, k) for (g, k, _), (_, kind) in nodes.items() if kind == M._TOP} == {("a", 3), ("b", 0), ("c", 3)}


def test_proofs_lead_to_the_root(spark, tmp_path):
    spark.createDataFrame(rows_of({"a": 30, "": 2, "b": 400}), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    made = M.build(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = M.proofs(made)
    assert got.where(M.fold_column(F.col("leaf"), F.col("path")) != made.root).count() == 0 and got.count() == 438
    assert {r.source for r in got.select("source").distinct().collect()} == {None, "", "a", "b"}
    assert got.where("source = 'b'").agg(F.max("position")).first()[0] == got.where("source = 'b'").count() - 1
    assert M.checked(made).where("not verified").count() == 0


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op13_merkle_manifest(spark, str(tmp_path)).count() == 0
    assert M.build(spark.read.parquet(f"{tmp_path}/documents.parquet")).root is None
