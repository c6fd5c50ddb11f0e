import corpus_pipeline as P
import public_tokenizers
from kerbside.llm import language_id, pii
from kerbside.llm.common import stored
from test_jaccard_join import brute as near
from test_tokens import check_packing, plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = [(9001, "?!? 12 --", None, "s", 9), (9002, None, None, None, None), (9003, "", "en", "s", 0)]
    first = docs.orderBy("doc_id").first()
    extra += [(9100, first.text, "en", "s", 1), (9101, first.text + " more", "en", "s", 1), (9102, "call +1 (555) 555-0199 or write to someone@mail.example.com " + "some quiet words " * 9, "en", "s", 1)]
    docs = stored(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "in")
    rows = {r.doc_id: r for r in docs.collect()}

    out = stored(P.language(spark, docs, ""), "one")
    assert out.columns == COLUMNS
    want = {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert {tuple(r) for r in out.collect()} == {tuple(rows[d]) for d in want}

    two = stored(P.exact_copies(spark, out, ""), "two")
    last = {}
    for d in sorted(want):
        last[rows[d].text] = d
    assert {tuple(r) for r in two.collect()} == {tuple(rows[d]) for d in last.values()}

    three = stored(P.near_copies(spark, two, ""), "three")
    want = {c for _, _, c in near([(d, rows[d].text) for d in last.values()])}
    assert {tuple(r) for r in three.collect()} == {tuple(rows[d]) for d in want}
    assert not {first.doc_id, 9100, 9101} <= want

    four = stored(P.personal_data(spark, three, ""), "four")
    assert four.columns == COLUMNS and four.count() == len(want)
    for r in four.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(rows[r.doc_id].text) and "<" not in r.text:
            assert r.text == rows[r.doc_id].text

    encode = plain(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(P.pack(spark, four, "").collect(), {r.doc_id: [encode(r.text) + [2]] for r in four.collect()}, 1024)


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 13
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"] and language_id


def test_language_without_labels_and_with_clashing_columns(spark):
    texts = ["some quiet words", "?!? 12 --", "été", None]
    kind = "doc_id long, text string, lang string, Score double, lang_pred string, _lang_pred string"
    for langs in ([None] * 4, [None, "en", None, "en"], ["und"] * 4, ["en", None, "und", None]):
        rows = [(i, t, lang, 0.5, "x", "y") for i, (t, lang) in enumerate(zip(texts, langs))]
        docs = spark.createDataFrame(rows, kind)
        out = P.language(spark, docs, "")
        assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]
