"""A manifest of a dataset as a Merkle tree: each row's proof and what it folds to.

Rows are leaves, ordered within their source; every ``ARITY`` neighbours become a node until a source has one node left, its subroot. Subroots in
order of their source are the leaves of the upper tree. A block is a run of ``ARITY ** levels`` leaves of one source, so it is one subtree, and one
call in a worker reduces it to one node. What blocks leave is reduced by the same step until at most ``top`` nodes are left. The driver
builds the tree over those, and broadcasts to the executors each node's path to the root; they read the rows once more, block by block, and
finish proofs and folds row by row. Where blocks were reduced more than once, the paths of the nodes in between meet their blocks by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storyloom.functions.session import checkpointed
from storyloom.llm.arrow import whole_groups
from storyloom.llm.ranks import ranked

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields one after another: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown)), 256)


def levels_of(nodes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """The nodes of each level above and including ``nodes``; a tree that is ``alone`` ends where it has one node."""
    out = [nodes]
    while len(out) <= levels and not (alone and len(out[-1]) == 1):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(levels: list[list[str]], i: int) -> Path:
    """For node ``i`` of the lowest level what stands left and right of it, and of each node above it, in its run."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % ARITY
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
        i //= ARITY
    return out


def height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def fold(node: str, path: Path) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _blocks(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """Nodes ``(tree, pos, total, hash, ...)`` dealt out by block, each block's in order, and written once."""
    block = F.expr(f"pos div {size}")
    named = nodes.withColumn("block", block).withColumn("group", F.concat(F.col("tree"), F.lit(":"), block.cast("string")))
    return checkpointed(named.repartition("group").sortWithinPartitions("group", "pos").select("group", "tree", "block", "pos", "total", "hash", *more))


def _reduced(blocks: DataFrame, levels: int) -> DataFrame:
    """One node for each block."""
    size = ARITY**levels
    schema = "tree string, pos long, total long, hash string"
    arrow = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("hash", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group"):
            out = []
            for _, group in groupby(t.select(["group", "tree", "block", "total", "hash"]).to_pylist(), key=lambda r: r["group"]):
                rows = list(group)
                total = rows[0]["total"]
                node = levels_of([r["hash"] for r in rows], levels, total <= size)[-1][0]
                out.append((rows[0]["tree"], rows[0]["block"], -(-total // size), node))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return checkpointed(blocks.select("group", "tree", "block", "total", "hash").mapInArrow(task, schema))


def _top(nodes: list[tuple[str, int, str]]) -> tuple[str | None, dict[tuple[str, int], Path]]:
    """The root, and each node's path to it; ``nodes`` are ``(tree, pos, hash)`` in order of the trees and of their nodes."""
    roots, paths = [], {}
    for tree, group in groupby(nodes, key=lambda n: n[0]):
        hashes = [h for _, _, h in group]
        levels = levels_of(hashes, len(hashes), True)
        roots.append((tree, levels[-1][0]))
        paths |= {(tree, i): siblings(levels, i) for i in range(len(hashes))}
    levels = levels_of([h for _, h in roots], len(roots), True)
    upper = {tree: siblings(levels, i) for i, (tree, _) in enumerate(roots)}
    return (levels[-1][0] if roots else None), {(tree, i): p + upper[tree] for (tree, i), p in paths.items()}


def _with_paths(blocks: DataFrame, levels: int, known, between: DataFrame | None, finish, schema: str) -> DataFrame:
    """``finish(row, path)`` for each node of the blocks, path being its siblings up to the root.

    The path of a block's node comes from the broadcast ``known``, or where that is too large from ``between(tree, pos, lefts, rights)``.
    """
    size, arrow, direct = ARITY**levels, to_arrow_schema(StructType.fromDDL(schema)), between is None
    if not direct:
        group = F.concat(F.col("tree"), F.lit(":"), F.col("pos").cast("string"))
        heads = between.select(group.alias("group"), "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "lefts", "rights")
        blocks = blocks.unionByName(heads, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "pos")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group"):
            out = []
            for _, group in groupby(t.to_pylist(), key=lambda r: r["group"]):
                rows = list(group)
                if direct:
                    above = known.value[rows[0]["tree"], rows[0]["block"]]
                else:
                    head, rows = rows[0], rows[1:]
                    above = list(zip(head["lefts"], head["rights"], strict=True))
                tree = levels_of([r["hash"] for r in rows], levels, rows[0]["total"] <= size)
                out += [finish(r, siblings(tree, i) + above) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return blocks.mapInArrow(task, schema)


def _middle(row: dict, path: Path) -> dict:
    return {"tree": row["own_tree"], "pos": row["own_pos"], "lefts": [a for a, _ in path], "rights": [b for _, b in path]}


def merkle_manifest(docs: DataFrame, forged_text: Column | None = None, levels: int = 6, top: int = 4096) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, forged_leaf, folded_root, verified)`` for every row of ``docs``.

    ``docs`` has the columns ``FIELDS``; others are ignored. Where ``forged_text`` isn't null, the row is folded as if that were its text. Leaves of a source ascend by doc_id (null first), then by their digest, so repeated rows are leaves each, and of equal leaves it doesn't matter which is first. A null source is a
    source of its own, the first. Null fields count as told in ``leaf_of``; an empty text is not a null one. An empty table gives an empty result.
    """
    spark, size = docs.sparkSession, ARITY**levels
    fields = [F.col(c) for c in FIELDS]
    forged = F.lit(None).cast("string") if forged_text is None else F.when(forged_text.isNotNull(), leaf_of([*fields[:-1], forged_text]))
    # a letter in front keeps the order of sources and tells null from any of them
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    leaves, _ = ranked(docs.select(F.col("doc_id"), tree.alias("tree"), leaf_of(fields).alias("hash"), forged.alias("forged_leaf")), "tree", ["doc_id", "hash"])
    rows = _blocks(leaves.withColumnRenamed("rank", "pos"), size, "doc_id", "forged_leaf")
    between: list[DataFrame] = []
    nodes, joined = _reduced(rows, levels), False
    while nodes.count() > top:
        step = nodes.select("tree", "pos", "total", "hash", F.col("tree").alias("own_tree"), F.col("pos").alias("own_pos"))
        if not joined and nodes.agg(F.max("total")).first()[0] == 1:  # every source has its subroot: they are one tree from now on
            one, _ = ranked(step.withColumn("tree", F.lit("")).drop("pos", "total"), "tree", ["own_tree"])
            step, joined = one.withColumnRenamed("rank", "pos"), True
        between.append(_blocks(step, size, "own_tree", "own_pos"))
        nodes = _reduced(between[-1], levels)
    few = nodes.select("tree", "pos", "hash").collect()  # at most ``top``
    root, paths = _top(sorted(((r.tree, r.pos, r.hash) for r in few), key=lambda n: (n[0].encode(), n[1])))
    known = spark.sparkContext.broadcast(paths)
    found = None
    for blocks in reversed(between):
        found = checkpointed(_with_paths(blocks, levels, known, found, _middle, "tree string, pos long, lefts array<string>, rights array<string>"))

    def finished(row: dict, path: Path) -> dict:
        own = height(row["total"])
        folded = fold(row["forged_leaf"] or row["hash"], path)
        return {
            "doc_id": row["doc_id"], "leaf": row["hash"], "subroot": fold(row["hash"], path[:own]), "root": root, "proof": "".join(a + b for a, b in path),
            "forged_leaf": row["forged_leaf"], "folded_root": folded, "verified": folded == root,
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_paths(rows, levels, known, found, finished, f"doc_id {kind}, leaf string, subroot string, root string, proof string, forged_leaf string, folded_root string, verified boolean")


def without_line_ends() -> Column:
    """The text without its line ends where 2 divides the checksum of doc_id; null elsewhere and where that changes nothing."""
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
