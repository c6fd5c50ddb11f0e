"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of fixed size. Sorting the distinct blocks gives each an integer name; then adjacent
pairs of names are sorted and named in the same way, again and again, until each text has one name. Two texts
have the same name only if they are the same bytes: nothing is hashed.

Block contents are shuffled once, and each map task sends a block that it holds many times only once, so that a
block which a third of all rows hold puts no more into one task than there are map tasks. Later levels shuffle
integers. Each level's names are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import stored, texts_of, utf8, with_row_id

BLOCK_BYTES = 4096

#: Bytes of distinct blocks that a map task remembers before it starts anew.
LOCAL_BYTES = 48 << 20


def _blocks(block_bytes: int):
    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen, kept, epoch = {}, 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rid, doc, pos, blocks, gen, no, block, sha = [], [], [], [], [], [], [], []
                for r, d, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    m = max(1, -(-len(text) // block_bytes))
                    for p in range(m):
                        b = text[p * block_bytes : (p + 1) * block_bytes]
                        n = seen.get(b)
                        block.append(b if n is None else None)
                        if n is None:
                            n = seen[b] = len(seen)
                            kept += len(b)
                        for column, v in ((rid, r), (doc, d), (pos, p), (blocks, m), (gen, part << 24 | epoch), (no, n), (sha, None if p else hashlib.sha256(text).digest())):
                            column.append(v)
                    if kept > LOCAL_BYTES:
                        seen, kept, epoch = {}, 0, epoch + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(blocks, pa.int64()), pa.array(gen, pa.int64()), pa.array(no, pa.int32()), pa.array(block, pa.binary()), pa.array(sha, pa.binary())],
                    names=["rid", "doc_id", "pos", "blocks", "gen", "no", "block", "sha"],
                )

    return run


def _named(batches):
    """(gen, no, name): rows come sorted, equal blocks together; equal neighbours share a name, and names ascend."""
    import pyarrow as pa
    from pyspark import TaskContext

    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        names = []
        for b in batch.column("block").to_pylist():
            if b != last or last is None:
                name, last = name + 1, b
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("gen"), batch.column("no"), pa.array(names, pa.int64())], names=["gen", "no", "name"])


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, sha (digest of the text), depth, name: one row per row of docs, (depth, name) equal where the texts' bytes are equal."""
    rows = with_row_id(texts_of(docs))
    cut = rows.mapInArrow(_blocks(block_bytes), "rid long, doc_id long, pos long, blocks long, gen long, no int, block binary, sha binary")
    blocks = stored(cut, "blocks")  # each distinct block of a map task once
    # sorted by a hash first, so that the sample which settles the ranges holds no contents; equal blocks are neighbours still
    first = blocks.where("block is not null").select("block", "gen", "no", F.xxhash64("block").alias("spread"))
    names = stored(first.repartitionByRange("spread").sortWithinPartitions("spread", "block").select("block", "gen", "no").mapInArrow(_named, "gen long, no int, name long"), "names")
    level = stored(blocks.select("rid", "pos", "blocks", "gen", "no").join(names, ["gen", "no"]).select("rid", "pos", "blocks", "name"), "level")
    depth, done = 0, []
    while True:
        # texts with one name left are done; a name counts together with its level
        done.append(level.where("blocks = 1").select("rid", F.lit(depth).alias("depth"), "name"))
        level = level.where("blocks > 1")
        if level.isEmpty():
            break
        pairs = stored(
            level.groupBy("rid", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("blocks") + 1, 1).alias("blocks")).agg(
                F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
            ),
            "pairs",
        )
        kinds = pairs.groupBy("a", "b").agg(F.lit(1).alias("one"))
        named = stored(kinds.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "names")
        level = stored(pairs.join(named, ["a", "b"]).select("rid", "pos", "blocks", "name"), "level")
        depth += 1
    return blocks.where("pos = 0").select("rid", "doc_id", "sha").join(reduce(DataFrame.unionByName, done), "rid")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256, rid.

    A null text counts as empty, so it equals an empty one. A null doc_id is smaller than any other; if all of a group
    are null, keep_id is null and one row of them is kept. Rows that repeat a doc_id and a text are copies of each
    other, of which the one with the largest row number (rid) is kept. An empty table gives an empty table. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    named = stored(block_names(docs, block_bytes), "named")
    groups = stored(named.groupBy("depth", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["depth", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "rid",
    )
