"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import texts_of

#: Texts longer than this many characters are cut at safe places before they are encoded.
SPLIT_CHARS = 200_000

#: White space after something else: no match of the split pattern goes over the place between the two.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_MADE: dict[tuple, object] = {}


def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, made once by each Python worker."""
    import tiktoken

    if (rank_path, pattern) not in _MADE:
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _MADE[rank_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[rank_path, pattern]


def pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """The text in pieces of about limit characters, cut only at safe places; a stretch without any stays whole."""
    start = 0
    while len(text) - start > limit and (cut := _SAFE.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str, limit: int = SPLIT_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in enc.encode_ordinary(piece)]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every whole text.

    A null text counts as empty and has no ids; repeated rows are each encoded; a null doc_id stays null;
    other columns are ignored whatever their names. One pass over the input, without a shuffle.
    """

    def run(batches):
        import numpy as np

        from kerbside.llm.common import by_bytes

        enc = encoding(rank_path, pattern)
        for batch, texts in by_bytes(batches):
            made = [np.array(encode_text(enc, t.decode(), split_chars), np.int32) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            values = pa.array(np.concatenate(made) if made else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """encoded and the column decoded (binary): the raw bytes of its ids, which need not be valid UTF-8. Null ids count as none."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        enc = encoding(rank_path, pattern)
        return ids.map(lambda x: b"" if x is None else enc.decode_bytes(x.tolist()))

    return encoded.withColumn("decoded", decoded("ids"))


def digests(docs: DataFrame, rank_path: str, pattern: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded from the ids, and digested in the same task."""

    def run(batches):
        import hashlib

        import numpy as np

        enc = encoding(rank_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode_text(enc, text or "", split_chars)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts_of(docs).mapInArrow(run, schema)
