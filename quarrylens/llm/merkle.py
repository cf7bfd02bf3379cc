"""Merkle manifest of a dataset: digests of rows, a tree of each group's rows, one tree over the groups' roots.

Rows are numbered within their tree by ranges of their order, so a tree of any size is built by many tasks. Every 512
consecutive nodes make an aligned block, a subtree of height three. Blocks are hashed apart; their roots are the nodes of
the next level, again in blocks, until each tree has one. Then the levels are walked downwards: within a block, treehash
stacks advance the authentication path leaf by leaf, and the path of the block's own root, shared by all its leaves, is
appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 8
#: Height of an aligned block.
HEIGHT = 3
BLOCK = ARITY**HEIGHT
_DIGITS = 64
_PATH = "array<struct<position:int,siblings:string>>"


def joined(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """The nodes of ``height`` over the leaves ``at`` to ``end``, built one leaf at a time.

    ``tail`` holds the nodes that wait for others of their run: at most seven for each height below.
    """

    def __init__(self, height: int, at: int, end: int):
        self.height, self.at, self.end = height, at, end
        self.tail: list[list[bytes]] = [[] for _ in range(height)]
        self.nodes: list[bytes] = []

    @property
    def done(self) -> bool:
        return self.at >= self.end

    def lowest(self) -> int:
        return next((h for h, waiting in enumerate(self.tail) if waiting), self.height)

    def advance(self, leaves: list[bytes]) -> None:
        node = leaves[self.at]
        self.at += 1
        for waiting in self.tail:
            waiting.append(node)
            # the last leaf closes the runs that have fewer nodes
            if len(waiting) < ARITY and not self.done:
                return
            node = joined(waiting)
            waiting.clear()
        self.nodes.append(node)

    def finish(self, leaves: list[bytes]) -> Treehash:
        while not self.done:
            self.advance(leaves)
        return self


def height_of(block: int, n: int) -> int:
    """Of the subtree of a block with n nodes: three, but for a tree's first block if it is not full, as it is then the only one."""
    if block:
        return HEIGHT
    return next(h for h in range(HEIGHT + 1) if n <= ARITY**h)


def block_root(leaves: list[bytes], height: int) -> bytes:
    return Treehash(height, 0, len(leaves)).finish(leaves).nodes[0]


def authentication_paths(leaves: list[bytes], height: int) -> Iterator[tuple[int, list[tuple[int, list[bytes]]]]]:
    """For each leaf in turn the nodes held, and for each level its place in its run and the run's nodes.

    While a run of a level serves, a treehash builds the level's next one. Each leaf grants as many steps as there are
    levels, each to the unfinished treehash whose lowest waiting node is lowest, so that few nodes wait at any time.
    """
    size = [ARITY ** (h + 1) for h in range(height)]
    run = lambda h, r: Treehash(h, r * size[h], min(len(leaves), (r + 1) * size[h]))
    now = [run(h, 0).finish(leaves).nodes for h in range(height)]
    after = [run(h, 1) for h in range(height)]
    for i in range(len(leaves)):
        for h in range(height):
            if i and i % size[h] == 0:
                now[h] = after[h].finish(leaves).nodes
                after[h] = run(h, i // size[h] + 1)
        held = sum(map(len, now)) + sum(len(t.nodes) + sum(map(len, t.tail)) for t in after)
        yield held, [(i // ARITY**h % ARITY, now[h]) for h in range(height)]
        for _ in range(height):
            behind = [t for t in after if not t.done]
            if behind:
                min(behind, key=lambda t: (t.lowest(), t.height)).advance(leaves)


def row_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over the columns in turn: '-' for null, else the number of UTF-8 bytes, ':' and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, the place of a row among those of its ``tree`` in the order of ``by``.

    Rows are dealt by range, equal ones in any order among themselves, and numbered where they are; what is joined is
    one count for each range and tree that meet.
    """
    salted = rows.withColumn("x_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange("tree", *by, "x_salt").sortWithinPartitions("tree", *by, "x_salt").drop("x_salt")
    dealt = written(dealt.withColumn("x_part", F.spark_partition_id()).withColumn("x_at", F.monotonically_increasing_id()), "ranges")
    parts = dealt.groupBy("tree", "x_part").agg(F.min("x_at").alias("x_first"), F.count("*").alias("x_n"))
    earlier = Window.partitionBy("tree").orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "x_part", (F.coalesce(F.sum("x_n").over(earlier), F.lit(0)) - F.col("x_first")).alias("x_shift"))
    return dealt.join(parts, ["tree", "x_part"]).withColumn("rank", F.col("x_shift") + F.col("x_at")).drop("x_part", "x_at", "x_shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, nodes): up to 512 consecutive nodes with their columns, in order."""
    rest = [c for c in nodes.columns if c not in ("tree", "rank")]
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct(*rest).alias("node"))))
    return written(nodes.groupBy("tree", F.floor(F.col("rank") / BLOCK).alias("block")).agg(listed.alias("nodes")), "blocks")


def _digests(nodes: pa.Array) -> list[bytes]:
    return [d.hex().encode() for d in nodes.flatten().field("node").field("digest").to_pylist()]


def _roots(blocks: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for block, nodes in zip(b.column("block").to_pylist(), _each(b.column("nodes")), strict=True):
                leaves = _digests(nodes)
                found.append(bytes.fromhex(block_root(leaves, height_of(block, len(leaves))).decode()))
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array(found, pa.binary())], ["tree", "rank", "digest"])

    return written(blocks.mapInArrow(hashed, "tree string, rank long, digest binary"), "roots")


def _each(lists: pa.Array) -> Iterator[pa.Array]:
    for i in range(len(lists)):
        yield lists.slice(i, 1)


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels of blocks, lowest first; roots: tree, digest) of ranked nodes (tree, rank, digest and other columns)."""
    levels = [_blocks(nodes)]
    while True:
        roots = _roots(levels[-1])
        if not roots.where("rank > 0").limit(1).count():
            return levels, roots.select("tree", "digest")
        levels.append(_blocks(roots))


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, rank, path, told, node) of the lowest level's nodes; ``above`` has tree, path and told for each tree's root.

    A path lists, from the node upwards, its place in its run and the run's other nodes.
    """
    found = above.select("tree", F.lit(0).cast("long").alias("rank"), "path", "told")
    for blocks in reversed(levels):
        node = blocks.schema["nodes"].dataType.elementType["node"].dataType
        told = found.schema["told"].dataType.simpleString()
        whole = blocks.join(found.select("tree", F.col("rank").alias("block"), "path", "told"), ["tree", "block"])
        found = written(whole.mapInArrow(_walk, f"tree string, rank long, path {_PATH}, told {told}, node {node.simpleString()}"), "paths")
    return found


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.string())]))
    for b in batches:
        for i, nodes in enumerate(_each(b.column("nodes"))):
            leaves, block = _digests(nodes), b.column("block")[i].as_py()
            shared = b.column("path")[i].as_py()
            own = [[{"position": at, "siblings": b"".join(run[:at] + run[at + 1 :]).decode()} for at, run in levels] + shared for _, levels in authentication_paths(leaves, height_of(block, len(leaves)))]
            flat = nodes.flatten()
            same = lambda name, i=i, n=len(leaves): b.column(name).take(pa.array([i] * n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([same("tree"), flat.field("rank"), pa.array(own, of), same("told"), flat.field("node")], ["tree", "rank", "path", "told", "node"])


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), received: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, leaf, received_leaf, subroot, root, path (array of position and siblings, leaf upwards).

    Leaves of a tree ascend by id, then by digest; null ids come first. Trees are ordered by their name's bytes, null
    first. ``received`` gives columns as they are found where the manifest is checked; ``received_leaf`` is their digest.
    Repeated rows are leaves each; texts are hashed whole and may be null or empty; an empty table has no rows and no
    root; other columns are not read, so they cannot clash. Digests are lowercase hex.
    """
    stored = {c: F.col(c) for c in columns}
    leaf, other = row_digest(stored), row_digest({**stored, **(received or {})})
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("received"))
    # written, as dealing by range reads its rows twice
    rows = written(rows.select("tree", "id", "digest", F.nullif("received", "digest").alias("received")), "leaves")
    levels, subroots = forest(ranked(rows, ["id", "digest"]))
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper, root = forest(ranked(tops, ["name"]))
    begin = root.select("tree", F.array().cast(_PATH).alias("path"), F.lower(F.hex("digest")).alias("told"))
    shared = paths(upper, begin).select(F.col("node.name").alias("tree"), "path", F.struct(F.lower(F.hex("node.digest")).alias("subroot"), F.col("told").alias("root")).alias("told"))
    found = paths(levels, shared)
    digest = F.lower(F.hex("node.digest"))
    return found.select(F.col("node.id").alias(id_col), digest.alias("leaf"), F.coalesce(F.lower(F.hex("node.received")), digest).alias("received_leaf"), "told.subroot", "told.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    around = lambda node, s: F.concat(F.substring(s["siblings"], F.lit(1), s["position"] * _DIGITS), node, F.substring(s["siblings"], s["position"] * _DIGITS + 1, F.char_length(s["siblings"])))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(around(node, s), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["siblings"]), ""), 256)
