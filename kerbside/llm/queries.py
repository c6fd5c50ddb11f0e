"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.toxicity import score, train

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = _documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.language_id import predict, train

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = _documents(spark, sf_dir)
    return predict(docs, train(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kerbside.llm.common import scratch
    from kerbside.llm.token_files import read_digests, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, spaces_dropped=True)
    return read_digests(spark, path)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.substring_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op5_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.jaccard_join import similar_groups

    return similar_groups(_documents(spark, sf_dir)).drop("rid", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.pii import find, train

    docs = _documents(spark, sf_dir)
    return find(docs, train(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kerbside.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_documents(spark, sf_dir)).drop("rid")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kerbside.llm.bpe import digests

    return digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.tiered_search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tier")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.guess_cost import dictionary, digests

    docs = _documents(spark, sf_dir)
    return digests(docs, dictionary(docs))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm.manifest import build, checked

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    return checked(build(_documents(spark, sf_dir), tampered)).drop("position")


def _search_sql() -> str:
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"unnest(regexp_extract_all({low}, '{term}'))"
    return f"""
        WITH words AS (SELECT doc_id, {words} term FROM documents),
        counts AS (SELECT doc_id, term, count(*) tf FROM words GROUP BY ALL),
        docs AS (SELECT doc_id, sum(tf)::BIGINT n FROM counts GROUP BY ALL),
        whole AS (SELECT count(*) nn, sum(n)::BIGINT ll FROM docs),
        wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {words} term FROM benchmark)),
        weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM counts, whole GROUP BY term, nn),
        scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT score
            FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), whole GROUP BY ALL),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS "rank", doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, "rank", doc_id, score FROM ranked WHERE "rank" <= 50"""


#: Levels of a source's tree, and of the tree over the sources, that the SQL has: 16 ** 6 rows a source, 16 ** 4 sources.
_SQL_LEVELS, _SQL_UPPER = 6, 4


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Tables name0 to name{levels} of nodes (g, i, d, m: how many there are) over leaves (g, i, d, m), with left and right siblings l, r."""
    run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
    sides = f"SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') r"
    out = [f"{name}0 AS ({sides} FROM ({leaves}))"]
    for k in range(1, levels + 1):
        up = f"SELECT g, i // 16 i, CASE WHEN max(m) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END d, (max(m) + 15) // 16 m FROM {name}{k - 1} GROUP BY g, i // 16"
        out.append(f"{name}{k} AS ({sides} FROM ({up}))")
    return ", ".join(out)


def _manifest_sql() -> str:
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || {x} END"
    digest = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # the unsigned crc32 of the decimal doc_id: each byte comes in, then eight bits go out
    steps = f"flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT{', -1' * 8}]))"
    crc = f"xor(list_reduce({steps}, lambda v, s: CASE WHEN s >= 0 THEN xor(v, s) ELSE xor(v >> 1, v % 2 * 3988292384) END, 4294967295::BIGINT), 4294967295)"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    fold, proof = "leaf2", []
    for tree, levels in (("t", _SQL_LEVELS), ("u", _SQL_UPPER)):
        for k in range(levels):
            fold = f"CASE WHEN {tree}{k}.m = 1 THEN {fold} ELSE sha256({tree}{k}.l || {fold} || {tree}{k}.r) END"
            proof.append(f"{tree}{k}.l || {tree}{k}.r")
    joins = " ".join(f"JOIN t{k} ON t{k}.g = n.g AND t{k}.i = n.i // {16**k}" for k in range(_SQL_LEVELS))
    joins += " JOIN u0 ON u0.name = n.g " + " ".join(f"JOIN u{k} ON u{k}.i = u0.i // {16**k}" for k in range(1, _SQL_UPPER))
    return f"""
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY g) m FROM (
            SELECT doc_id, coalesce('+' || source, '') g, {digest('text')} leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(low)} ELSE {digest('text')} END leaf2 FROM documents)),
        {_tree_sql('t', 'SELECT g, i, leaf d, m FROM n', _SQL_LEVELS)},
        {_tree_sql('u', f"SELECT 0 g, row_number() OVER (ORDER BY g) - 1 i, d, count(*) OVER () m, g AS name FROM t{_SQL_LEVELS}", _SQL_UPPER)}
        SELECT *, folded_root = root verified FROM (
            SELECT doc_id, leaf, u0.d subroot, (SELECT d FROM u{_SQL_UPPER}) root, sha256({' || '.join(proof)}) proof_sha256, {fold} folded_root FROM n {joins})"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
        "op11_tiered_search": _search_sql(),
        "op13_merkle_manifest": _manifest_sql(),
    }
