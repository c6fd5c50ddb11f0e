import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, name string"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Null, empty, repeated, tied and very long texts, and columns whose names clash with those of operators."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n\t ", "Don't  stop  now\x1c ok", "<|endoftext|> it's", say(30), say(30000), "x" * 50000, "日本語 テキスト 😀 é", "a\r\nb　c  ", say(900)]
    rows = [(i, t, None if i % 3 else "en", None, 1, "x", "y") for i, t in enumerate(texts)]
    rows += [(i + 100, t, "de", "s", None, None, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
