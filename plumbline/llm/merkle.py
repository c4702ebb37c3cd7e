"""Merkle manifest of a dataset: a digest of every row, a subroot for each language, one root, and a proof a row.

A node is the hex SHA-256 of its children's hex digests; every two consecutive nodes have a parent,
and an odd last one has a parent of its own.  Leaves are digested where their rows are read, so no
text is shuffled.  Their places come from a range partitioning and the counts of its partitions.

An aligned block of leaves is one group: a postorder recursion returns a subtree's digest and,
while it unwinds, appends the sibling to the leaves below.  Block roots are the nodes of the next
traversal, so there are as many rounds as the largest tree has blocks of levels; subroots, by
language, are the leaves of one more tree.  What stands above a block is joined to its leaves once,
from the top down.

Every round is a stored table, so a lost executor costs its own tasks only, and no task gets more
than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, joined_by_key, portions, spark_schema, stored

#: Levels of a block; it has 2 ** LEVELS leaves.
LEVELS = 10
#: Bytes of a digest in its short form, in which tables keep it.
SHORT = 32

CLIMBED = arrow_schema(tree=pa.string(), at=pa.int64(), size=pa.int64(), siblings=pa.binary(), top=pa.binary())
PROVED = arrow_schema(doc_id=pa.int64(), leaf=pa.string(), subroot=pa.string(), root=pa.string(), proof_sha256=pa.string(), folded_root=pa.string(), verified=pa.bool_())

#: The columns that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(values: list[Column]) -> Column:
    """H of values, each "-" if null, else the bytes its text has, ":", and the text; as hex."""
    told = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*told), 256)


def parent(left: bytes, right: bytes = b"") -> bytes:
    """The digest over one or two children, all in the short form."""
    return hashlib.sha256((left.hex() + right.hex()).encode()).digest()


def visit(leaves: list[bytes], low: int, height: int, siblings: list[list[bytes]]) -> bytes:
    """The digest of the subtree of that height over the leaves from low on, its siblings appended to the leaves it holds."""
    if not height:
        return leaves[low]
    middle, end = low + (1 << height - 1), min(low + (1 << height), len(leaves))
    left = visit(leaves, low, height - 1, siblings)
    if middle >= end:
        return parent(left)
    right = visit(leaves, middle, height - 1, siblings)
    for k in range(low, middle):
        siblings[k].append(right)
    for k in range(middle, end):
        siblings[k].append(left)
    return parent(left, right)


def height(size: int) -> int:
    """Levels above the leaves of a tree of that many."""
    return max(size - 1, 0).bit_length()


def _climb(levels: int):
    """One block, its rows in any order, to the siblings within the block, and the block's root on its first leaf."""

    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        leaves, sizes = block.column("digest").to_pylist(), block.column("size")
        siblings: list[list[bytes]] = [[] for _ in leaves]
        top = visit(leaves, 0, min(levels, height(sizes[0].as_py())), siblings)
        tops = [top] + [None] * (len(leaves) - 1)
        columns = [block.column("tree"), block.column("at"), sizes, pa.array(map(b"".join, siblings), pa.binary()), pa.array(tops, pa.binary())]
        return pa.Table.from_arrays(columns, schema=CLIMBED)

    return climb


def climbed(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of (tree, at, size, digest), at from 0 to size - 1 in each tree: all siblings of each node, and each tree's root.

    Returns (tree, at, siblings: short forms from the node up, left to right) and (tree, top).
    """
    largest = nodes.agg(F.max("size")).first()[0] or 1
    rounds, level, block_size = [], nodes, 1 << levels
    while True:
        block = F.shiftright("at", levels).alias("block")
        rounds.append(stored(level.groupBy("tree", block).applyInArrow(_climb(levels), spark_schema(CLIMBED)), "merkle-round"))
        largest = (largest + block_size - 1) >> levels
        roots = rounds[-1].where("top IS NOT NULL")
        if largest <= 1:
            break
        # A tree of one block is done; its root goes no further.
        above = F.shiftright(F.col("size") + (block_size - 1), levels)
        level = roots.where(F.col("size") > block_size).select("tree", F.shiftright("at", levels).alias("at"), above.alias("size"), F.col("top").alias("digest"))
    paths = rounds[-1].select("tree", "at", "siblings")
    for below in reversed(rounds[:-1]):
        upper = paths.select("tree", F.col("at").alias("block"), F.col("siblings").alias("upper"))
        joined = below.withColumn("block", F.shiftright("at", levels)).join(upper, ["tree", "block"], "left")
        paths = joined.select("tree", "at", F.concat("siblings", F.coalesce("upper", F.lit(b""))).alias("siblings"))
    tops = [r.where((F.col("top").isNotNull()) & (F.col("size") <= block_size)).select("tree", "top") for r in rounds]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return paths, roots


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows, stored, with at: the place among those of the same tree, from 0, by order (nulls first), and size: how many they are.

    Rows that are equal in tree and order are told apart by where they are read, so they too are dealt out.
    """
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_read").sortWithinPartitions(tree, *order, "_read").drop("_read")
    numbered = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "merkle-placed")
    counts = numbered.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_begin"))
    own = Window.partitionBy(tree)  # a row for each partition that holds part of the tree
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(tree, "_part", (F.coalesce(before, F.lit(0)) - F.col("_begin")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    return numbered.join(begins, [tree, "_part"]).withColumn("at", F.col("_nth") + F.col("_shift")).drop("_part", "_nth", "_begin", "_shift")


def fold(leaf: bytes, siblings: Iterator[bytes], at: int, size: int) -> bytes:
    """The root of a tree from one of its leaves, the leaf's place and its siblings from below."""
    while size > 1:
        if at % 2:
            leaf = parent(next(siblings), leaf)
        elif at + 1 < size:
            leaf = parent(leaf, next(siblings))
        else:
            leaf = parent(leaf)
        at, size = at // 2, (size + 1) // 2
    return leaf


def _prove(batches):
    """Digest of a proof's siblings, and the root that a leaf folds to; digests become hex."""
    for batch in batches:
        for part in portions([batch], "siblings"):
            rows = part.to_pydict()
            proofs, folded = [], []
            for path, leaf, at, size, tree_at, trees in zip(*(rows[c] for c in ("siblings", "shown", "at", "size", "tree_at", "trees")), strict=True):
                each = iter([path[k : k + SHORT] for k in range(0, len(path), SHORT)])
                proofs.append(hashlib.sha256(path.hex().encode()).hexdigest())
                folded.append(fold(fold(leaf, each, at, size), each, tree_at, trees).hex())
            leaf, subroot, root = ([x.hex() for x in rows[c]] for c in ("digest", "subroot", "root"))
            same = [a == b for a, b in zip(folded, root, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (leaf, subroot, root, proofs, folded), [pa.string()] * 5), pa.array(same, pa.bool_())], schema=PROVED)


def manifest(docs: DataFrame, tampered: Column, levels: int = LEVELS, **changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    Where tampered holds, the row that a proof is folded from has the changed columns; the leaves,
    subroots and root are those of the rows as they are.

    Defined results: null columns count as "-", a null language has a tree of its own before all
    others; rows equal in language and doc_id stand by leaf; repeated rows are leaves each; a null
    condition is false; further columns are ignored; an empty table gives no row.
    """
    covered = lambda given: row_digest([given.get(c, F.col(c)) for c in COVERED])
    leaf = covered({})
    shown = F.when(tampered, covered(changed)).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")  # null first, then bytewise
    digests = stored(docs.select(tree, F.col("doc_id").cast("long"), F.unhex(leaf).alias("digest"), F.unhex(shown).alias("shown")), "merkle-digests")
    leaves = stored(placed(digests, "tree", "doc_id", "digest"), "merkle-leaves")
    paths, subroots = climbed(leaves.select("tree", "at", "size", "digest"), levels)

    ranked = stored(placed(subroots.select(F.lit("").alias("forest"), "tree", "top"), "forest", "tree"), "merkle-trees")
    above, roots = climbed(ranked.select(F.col("forest").alias("tree"), "at", "size", F.col("top").alias("digest")), levels)
    trees = ranked.select("tree", F.col("at").alias("tree_at"), F.col("size").alias("trees"), F.col("top").alias("subroot"))
    upper = above.select(F.col("at").alias("tree_at"), F.col("siblings").alias("upper"))
    weights = leaves.where("at = 0").select("tree", F.col("size").alias("leaves"))
    # One row is broadcast: the root of the one tree of subroots.
    trees = trees.join(upper, "tree_at").join(weights, "tree").join(F.broadcast(roots.select(F.col("top").alias("root"))))
    facts = stored(trees, "merkle-facts")
    whole = joined_by_key(leaves.join(paths, ["tree", "at"]), facts, "tree", "leaves")
    whole = whole.select("doc_id", "digest", "shown", "at", "size", "tree_at", "trees", "subroot", "root", F.concat("siblings", "upper").alias("siblings"))
    return whole.mapInArrow(_prove, spark_schema(PROVED))
