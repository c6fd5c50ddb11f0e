"""A Merkle manifest of a dataset: a tree of digests per source, one over the sources, and a proof for every row.

Rows are sorted by source and doc_id over range partitions. Rows of each source in each partition are counted; running
sums of the counts say where a partition's rows stand in their source. Each task then builds the complete aligned
subtrees of what it reads; nodes whose run of siblings goes over its borders (at most 15 at either end of each level) are
shuffled by their coordinates and finished level by level. The same is done with the subroots in the order of sources.
Siblings on the way to the root are handed down from the top to blocks of 256 leaves, whose tasks make the proofs.

A digest H is the SHA-256 in lower-case hexadecimal of its inputs, one after the other, digests as text.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import small_batches, stored

#: Children of a node, and the level whose subtrees are the blocks that proofs are made in.
FAN, BLOCK_LEVEL = 16, 2
#: Rows of a range partition: no more than that many, and no fewer while partitions are as many as shuffles have.
MOST_ROWS, LEAST_ROWS = 1_000_000, 2_000

_INNER, _RAGGED, _TOP = 0, 1, 2
NODES = "g string, level int, idx long, digest binary, kind int"


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(c) -> Column:
    """A value as text that no other value has: - for null, else its length in bytes, a colon, itself."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text=None) -> Column:
    """The digest, binary, of doc_id, source, lang, n_chars and text (or a given column instead of text)."""
    return F.unhex(F.sha2(F.concat(*map(field, ("doc_id", "source", "lang", "n_chars", "text" if text is None else text))), 256))


@dataclass(frozen=True)
class Forest:
    """leaves: a tree's name g, position in it, digest and further columns; nodes: those of BLOCK_LEVEL and above, and the tops."""

    leaves: DataFrame
    nodes: DataFrame

    @property
    def tops(self) -> DataFrame:
        """g, level, digest of each tree's top."""
        return self.nodes.where("top").select("g", "level", "digest")


def _numbered(batches):
    """Adds part, row and at: the partition, the row's place in it, and its place among those of its tree in it. Rows come sorted by g."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), None, 0
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g")
        new = np.concatenate([[g[0].as_py() != last], pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False).astype(bool)])
        starts = np.flatnonzero(new)
        if new[0]:
            n = 0
        at = np.arange(len(g)) + n
        if len(starts):
            first = starts[np.searchsorted(starts, np.arange(len(g)), "right") - 1]
            later = np.arange(len(g)) >= starts[0]
            at = np.where(later, np.arange(len(g)) - first, at)
        last, n = g[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part)), pa.array(np.arange(len(g)) + rows), pa.array(at)], names=[*batch.schema.names, "part", "row", "at"])
        rows += len(g)


class _Subtrees:
    """The complete aligned subtrees over successive leaves of one tree; what belongs to larger ones is given out as ragged."""

    def __init__(self, g: str, out: list):
        self.g, self.out, self.start, self.held = g, out, [], []

    def _emit(self, level: int, start: int, digests: list[str], kind: int) -> None:
        self.out += [(self.g, level, start + i, d, kind) for i, d in enumerate(digests)]

    def _up(self, level: int, at: int, digests: list[str]) -> None:
        """A run's children, complete, go out where paths need them; their parent goes a level up."""
        if level >= BLOCK_LEVEL:
            self._emit(level, at, digests, _INNER)

    def feed(self, level: int, at: int, digests: list[str]) -> None:
        if level == len(self.held):
            self.held.append([])
            self.start.append(at)
        held = self.held[level]
        if not held:
            self.start[level] = at
        held += digests
        if head := -self.start[level] % FAN:  # the rest of a run that began before what is read here
            if len(held) < head:
                return
            self._emit(level, self.start[level], held[:head], _RAGGED)
            del held[:head]
            self.start[level] += head
        whole = len(held) // FAN
        if whole:
            at, full = self.start[level], held[: whole * FAN]
            del held[: whole * FAN]
            self.start[level] += whole * FAN
            self._up(level, at, full)
            self.feed(level + 1, at // FAN, [_h("".join(full[i : i + FAN])) for i in range(0, len(full), FAN)])

    def close(self, size: int | None) -> None:
        """No more leaves here; size: of the whole tree, if it ends here."""
        level = 0
        while level < len(self.held):
            held, start = self.held[level], self.start[level]
            alone = size is not None and -(-size // FAN**level) == 1
            if held and alone:
                self._emit(level, 0, held, _TOP)
            elif held and size is not None and start % FAN == 0:
                self._up(level, start, held)
                self.held[level] = []
                self.feed(level + 1, start // FAN, [_h("".join(held))])
            elif held:
                self._emit(level, start, held, _RAGGED)
            level += 1


def _subtrees(batches):
    """NODES of rows (g, part, row, pos, digest), which come in their order, though a task may begin or end anywhere."""
    import pyarrow as pa

    def give(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array([bytes.fromhex(d) for d in columns[3]], pa.binary()), pa.array(columns[4], pa.int32())], names=["g", "level", "idx", "digest", "kind"]
        )

    out, tree, last, place = [], None, None, None
    for batch in batches:
        g, part, row, pos = (batch.column(c).to_pylist() for c in ("g", "part", "row", "pos"))
        digests = [d.hex() for d in batch.column("digest").to_pylist()]
        i = 0
        while i < len(g):
            j = i + 1
            while j < len(g) and pos[j] == pos[j - 1] + 1 and g[j] == g[i]:
                j += 1
            if tree is None or last != (g[i], pos[i] - 1):
                if tree is not None:
                    # where the next row of the partition is another tree's, the last tree is whole
                    tree.close(last[1] + 1 if (part[i], row[i] - 1) == place and g[i] != last[0] else None)
                tree = _Subtrees(g[i], out)
            tree.feed(0, pos[i], digests[i:j])
            last, place = (g[j - 1], pos[j - 1]), (part[j - 1], row[j - 1])
            i = j
        if len(out) > 10_000:
            yield give(out)
            out.clear()
    if tree is not None:
        tree.close(None)
    yield give(out)


def _height(n: Column) -> Column:
    """The level at which n leaves have one node."""
    out = F.lit(15)
    for level in range(14, -1, -1):
        out = F.when(n <= FAN**level, level).otherwise(out)
    return out


def _run_digest() -> Column:
    """H of the digests of a group's nodes in their order."""
    return F.unhex(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: F.lower(F.hex(x["digest"]))), ""), 256))


def forest(leaves: DataFrame, order: list[str]) -> Forest:
    """Trees over stored leaves: g (not null), digest (binary) and other columns; order: the columns that leaves of a tree ascend by.

    Rows equal in all of order stand in any order.
    """
    spark = leaves.sparkSession
    rows = leaves.count()
    parts = max(-(-rows // MOST_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)), 1)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    ranged = leaves.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    ranged = stored(ranged.mapInArrow(_numbered, f"{kind}, part long, row long, at long"), "ranged")
    # of each tree, a row per partition that has some of it
    counts = stored(ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only a partition's first tree can have begun before it: no more rows than partitions
    offsets = stored(counts.select("g", "part", F.coalesce(before, F.lit(0)).alias("offset")).where("offset > 0"), "offsets")
    placed = ranged.join(F.broadcast(offsets), ["g", "part"], "left").withColumn("pos", F.col("at") + F.coalesce("offset", F.lit(0))).drop("at", "offset")
    local = stored(placed.select("g", "part", "row", "pos", "digest").mapInArrow(_subtrees, NODES), "local")
    ragged = local.where(F.col("kind") == _RAGGED)
    sizes = counts.join(ragged.select("g").distinct(), "g", "left_semi").groupBy("g").agg(_height(F.sum("n")).alias("height"))
    ragged = stored(ragged.join(sizes, "g").select("g", "level", "idx", "digest", "height"), "ragged")
    highest = ragged.agg(F.max("height")).first()[0] or 0
    done, made = [ragged], None
    for level in range(highest):
        waiting = ragged.where((F.col("level") == level) & (F.col("height") > level))
        if made is not None:
            waiting = waiting.unionByName(made.where(F.col("height") > level))
        up = waiting.groupBy("g", F.expr(f"idx div {FAN}").alias("up"), "height").agg(_run_digest().alias("digest"))
        made = stored(up.select("g", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest", "height"), "made")
        done.append(made)
    nodes = local.where(F.col("kind") != _RAGGED).select("g", "level", "idx", "digest", (F.col("kind") == _TOP).alias("top"))
    for table in done:
        top = F.col("height") == F.col("level")
        nodes = nodes.unionByName(table.where(top | (F.col("level") >= BLOCK_LEVEL)).select("g", "level", "idx", "digest", top.alias("top")))
    return Forest(placed.drop("part", "row"), stored(nodes, "nodes"))


def _block_paths(trees: Forest, tops: DataFrame) -> DataFrame:
    """g, block, level, path and the other columns of tops (g, level, path, ...): the siblings from a block's top to the root.

    A path is a list of left and right siblings, as text. Those of a level come from the level above; there are as many
    rows at the end as blocks, a 256th of the leaves.
    """
    more = [c for c in tops.columns if c not in ("g", "level", "path")]
    tops = stored(tops, "tops")
    above = None
    for level in range(max(tops.agg(F.max("level")).first()[0] or 0, BLOCK_LEVEL), BLOCK_LEVEL - 1, -1):
        here = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("idx"), "path", *more)
        if above is not None:
            runs = trees.nodes.where((F.col("level") == level) & ~F.col("top")).groupBy("g", F.expr(f"idx div {FAN}").alias("up"))
            runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", F.lower(F.hex("digest")).alias("d")))).alias("run"))
            each = runs.join(above.withColumnRenamed("idx", "up"), ["g", "up"]).select("g", "path", *more, "run", F.posexplode("run").alias("k", "node"))
            side = lambda start, n: F.array_join(F.transform(F.slice("run", start, n), lambda x: x["d"]), "")
            siblings = F.struct(side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 2, F.lit(FAN)).alias("right"))
            here = here.unionByName(each.select("g", F.col("node.idx").alias("idx"), F.concat(F.array(siblings), "path").alias("path"), *more))
        above = stored(here, "paths")
    blocks = above.select("g", F.col("idx").alias("block"), F.lit(BLOCK_LEVEL).alias("level"), "path", *more)
    return blocks.unionByName(tops.where(F.col("level") < BLOCK_LEVEL).select("g", F.lit(0).cast("long").alias("block"), "level", "path", *more))


def _paths_within(digests: list[str], level: int, path: list[dict]) -> list[list[tuple[str, str]]]:
    """The (left, right) siblings of each of a block's leaves, up to the root."""
    levels = [digests]
    for _ in range(level):
        levels.append([_h("".join(levels[-1][i : i + FAN])) for i in range(0, len(levels[-1]), FAN)])
    paths = [[(p["left"], p["right"]) for p in path]]
    for nodes in reversed(levels[:-1]):
        down = []
        for i in range(0, len(nodes), FAN):
            run, above = nodes[i : i + FAN], paths[i // FAN]
            down += [[("".join(run[:k]), "".join(run[k + 1 :])), *above] for k in range(len(run))]
        paths = down
    return paths


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        digest = _h(f"{left}{digest}{right}")
    return digest


def fold_column(digest, path) -> Column:
    """The same for columns: a digest as text and an array<struct<left,right>>."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def _each_leaf(trees: Forest, paths: DataFrame, columns: str, make) -> DataFrame:
    """Rows (columns) that make() gives for the sorted leaves of a block, their paths, and the row of the block."""
    small_batches(paths.sparkSession)

    def run(leaves, block):
        import pyarrow as pa

        leaves, rows = leaves.sort_by("pos"), block.to_pylist()
        out = make(leaves, _paths_within([d.hex() for d in leaves.column("digest").to_pylist()], rows[0]["level"], rows[0]["path"]), rows[0]) if leaves.num_rows else []
        return pa.Table.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(paths.sparkSession.createDataFrame([], columns).schema)
    block = trees.leaves.withColumn("block", F.expr(f"pos div {FAN**BLOCK_LEVEL}"))
    return block.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(run, columns)


@dataclass(frozen=True)
class Manifest:
    """root: of the dataset, null without rows; sources: of each source's name (g), its subroot and path to the root."""

    trees: Forest
    sources: DataFrame
    root: str | None


#: Of a path: siblings left and right of the node, level by level.
PATH = "array<struct<left:string,right:string>>"


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The trees of docs (doc_id, source, lang, n_chars, text); changed: what other texts are to be checked against it.

    Nulls count as such: a null source has a tree of its own, which comes first, and a null doc_id comes first in its
    source. Rows with the same doc_id and source ascend by their digests; repeated rows are leaves each. Other columns
    are ignored, whatever their names. The text is read once; what is shuffled is two digests a row.
    """
    small_batches(docs.sparkSession)
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    other = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), leaf(changed))
    rows = docs.select(name.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("place"))
    trees = forest(stored(rows, "leaves"), ["doc_id", "digest", "place"])
    over = forest(stored(trees.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", "level"), "subroots"), ["name"])
    root = over.tops.first()
    ends = over.tops.select("g", "level", F.from_json(F.lit("[]"), PATH).alias("path"))

    def make(leaves, paths, _):
        return [{"g": g, "level": n, "subroot": d.hex(), "path": [{"left": a, "right": b} for a, b in p]} for g, n, d, p in zip(*(leaves.column(c).to_pylist() for c in ("name", "level", "digest")), paths, strict=True)]

    sources = _each_leaf(over, _block_paths(over, ends), f"g string, level int, subroot string, path {PATH}", make)
    return Manifest(trees, stored(sources, "sources"), root.digest.hex() if root else None)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, source, position, leaf, subroot, path of every row: the siblings on the way to the root (see fold_column())."""

    def make(leaves, paths, block):
        columns = (leaves.column(c).to_pylist() for c in ("doc_id", "pos", "digest"))
        return [{"doc_id": d, "source": block["g"][1:] if block["g"] else None, "position": i, "leaf": x.hex(), "subroot": block["subroot"], "path": [{"left": a, "right": b} for a, b in p]} for d, i, x, p in zip(*columns, paths, strict=True)]

    return _each_leaf(manifest.trees, _block_paths(manifest.trees, manifest.sources), f"doc_id long, source string, position long, leaf string, subroot string, path {PATH}", make)


def checked(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position of every row.

    proof_sha256 is H of a row's siblings; folded_root is what the changed text (see build()), or else the row itself,
    leads to with them; verified says whether that is the root. No rows give no rows.
    """
    root = manifest.root

    def make(leaves, paths, block):
        out = []
        for d, i, x, other, path in zip(*(leaves.column(c).to_pylist() for c in ("doc_id", "pos", "digest", "other")), paths, strict=True):
            end = folded((other or x).hex(), path)
            out.append({"doc_id": d, "leaf": x.hex(), "subroot": block["subroot"], "root": root, "proof_sha256": _h("".join(a + b for a, b in path)), "folded_root": end, "verified": end == root, "position": i})
        return out

    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    return _each_leaf(manifest.trees, _block_paths(manifest.trees, manifest.sources), columns, make)
