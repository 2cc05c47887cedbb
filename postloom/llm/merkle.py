"""A Merkle manifest of a table: one tree a language, one tree over their roots, and every row's proof.

The hash of a row (its leaf) is made by Spark's own functions; from then on only hashes move. Leaves get their place within
their language by a range sort: each sorted partition counts its rows of a language, and running sums of these counts are
the offsets, so no language is ever sorted in one task.

Trees grow by appending. An append meets the open subtrees at the right edge: while the last of them is as high as the new
one, both become one subtree, the witnesses of the left one's leaves are extended by the right root and those of the right
one by the left root. A subtree whose sibling has not come yet stays open with its leaves' partial witnesses. Appends are
dealt in aligned blocks of BLOCK leaves (a power of two), so a block is a complete subtree and blocks are appended
independently of each other in many tasks. The roots of blocks are appended in the same way, in blocks again, until a
language has one root; the languages' roots are appended last. On the way back, each block's witness, once complete,
extends the witnesses of what was appended in it.

So a task holds one block and nothing grows with the table; the number of rounds is log(rows) / log(BLOCK).

Defined cases: null fields are hashed as ``-``; a null doc_id comes first in its language and is tampered with as the empty
text; repeated rows and repeated ids are leaves of their own, equal ids in the order of their hash; an empty table gives no
rows; a language with one row has its leaf as root. Columns other than the hashed ones are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import fields, fold_of
from postloom.session import cut_lineage

BLOCK = 1024
TAMPERED_FOLD = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64                                   # hexadecimal digits
PARENT = "group string, place long, subroot string, root string, steps string, siblings string"


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values: Iterable[Column]) -> Column:
    """The hash of a row's fields: ``-`` for null, else byte count, colon and value."""
    shown = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (f.cast("string") for f in values)]
    return F.sha2(F.concat(*shown), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, group (``n`` for the null language, else ``v`` and the language), digest, tampered (null where nothing is)."""
    docs = fields(docs, *FIELDS)
    own = {c: F.col(c) for c in FIELDS}
    more = own | {"n_chars": F.col("n_chars") + F.lit(1)}
    changed = (fold_of(TAMPERED_FOLD) == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n")).alias("group"),
                       leaf_of(own.values()).alias("digest"), F.when(changed, leaf_of(more.values())).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``, the row's number within its ``group`` by ``order``, and ``total``, the group's number of rows."""
    ordered = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    # the id counts up within a partition, in the order of its rows
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33)
    runs = ordered.groupBy("group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("group").orderBy("_part")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("group", "_part", "_first", F.sum("_n").over(every).alias("total"),
                       (F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return (ordered.withColumn("_part", part).join(runs, ["group", "_part"])
            .withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before"))


class OpenTree:
    """Subtrees that wait for their sibling, highest first, and the witnesses of all leaves appended so far.

    A witness is a list of steps from the leaf upwards: (``L`` or ``R``, the sibling on that side), or (``-``, nothing).
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int, int]] = []      # height, digest, first leaf, leaf after the last
        self.witness: list[list[tuple[str, str]]] = []

    def _joined(self, node: tuple[int, str, int, int]) -> tuple[int, str, int, int]:
        """``node`` and all open subtrees that are its left siblings, one after the other, as one subtree."""
        while self.open and self.open[-1][0] == node[0]:
            height, left, first, middle = self.open.pop()
            for w in self.witness[first:middle]:
                w.append(("R", node[1]))
            for w in self.witness[middle:node[3]]:
                w.append(("L", left))
            node = (height + 1, hashed(left, node[1]), first, node[3])
        return node

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self.open.append(self._joined((0, digest, at, at + 1)))

    def close(self, height: int | None = None) -> str:
        """The root, with what is missing at the right edge left out: of the given height, else as low as one root can be."""
        node = self.open.pop()
        while self.open or (height is not None and node[0] < height):
            for w in self.witness[node[2]:node[3]]:
                w.append(("-", ""))
            node = self._joined((node[0] + 1, hashed(node[1]), node[2], node[3]))
        return node[1]


def grown(digests: Iterable[str], total: int, block: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and witnesses of one block of a group of ``total`` nodes: a lone block ends at its root, others are equally high."""
    tree = OpenTree()
    for d in digests:
        tree.append(d)
    return tree.close(None if total <= block else block.bit_length() - 1), tree.witness


def folded(leaf: str, steps: str, siblings: str) -> str:
    """The root that a leaf and its witness lead to."""
    at = 0
    for side in steps:
        if side == "-":
            leaf = hashed(leaf)
            continue
        other, at = siblings[at:at + DIGEST], at + DIGEST
        leaf = hashed(other, leaf) if side == "L" else hashed(leaf, other)
    return leaf


def _ordered(nodes: pa.Table) -> pa.Table:
    return nodes.take(pa.array(np.argsort(nodes.column("place").to_numpy(), kind="stable")))


def _block_of(block: int) -> Column:
    return F.floor(F.col("place") / F.lit(block)).cast("long").alias("place")


def roots_of_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """group, place, total, digest: the blocks of ``nodes`` as nodes of the next round."""
    def root(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        total = table.column("total")[0].as_py()
        made, _ = grown(table.column("digest").to_pylist(), total, block)
        return pa.table({"group": [table.column("group")[0].as_py()], "place": [table.column("place")[0].as_py() // block],
                         "total": [-(-total // block)], "digest": [made]})

    return nodes.select("group", "place", "total", "digest").groupBy("group", _block_of(block).alias("_block")).applyInArrow(
        root, "group string, place long, total long, digest string")


def _extended(nodes: pa.Table, parent: pa.Table, block: int) -> Iterator[tuple[str, str]]:
    """(steps, siblings) of each of the ordered ``nodes`` of one block, extended by the witness of their block."""
    above_steps, above = parent.column("steps")[0].as_py(), parent.column("siblings")[0].as_py()
    _, witness = grown(nodes.column("digest").to_pylist(), nodes.column("total")[0].as_py(), block)
    for w in witness:
        yield "".join(side for side, _ in w) + above_steps, "".join(other for _, other in w) + above


def _meet(nodes: DataFrame, parents: DataFrame, block: int):
    return nodes.groupBy("group", _block_of(block).alias("_block")).cogroup(parents.groupBy("group", F.col("place").alias("_block")))


def extended(nodes: DataFrame, parents: DataFrame, block: int) -> DataFrame:
    """``nodes`` with their whole witness, as parents of what was appended in them."""
    def work(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = _ordered(table)
        made = list(_extended(table, parent, block))
        n = table.num_rows
        same = {c: parent.column(c)[0].as_py() for c in ("subroot", "root")}
        return pa.table({"group": table.column("group"), "place": table.column("place"), **{c: [v] * n for c, v in same.items()},
                         "steps": [s for s, _ in made], "siblings": [x for _, x in made]},
                        schema=pa.schema([("group", pa.string()), ("place", pa.int64()), *[(c, pa.string()) for c in
                                          ("subroot", "root", "steps", "siblings")]]))

    return _meet(nodes.select("group", "place", "total", "digest"), parents, block).applyInArrow(work, PARENT)


def rounds(nodes: DataFrame, block: int) -> list[DataFrame]:
    """``nodes`` and the block roots of every round, until each group has one."""
    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        out.append(cut_lineage(roots_of_blocks(out[-1], block), "merkle-round"))
        most = -(-most // block)
    return out


def language_parents(subroots: DataFrame, block: int) -> DataFrame:
    """The languages' roots with their witness up to the root of all."""
    nodes = subroots.select(F.lit("").alias("group"), F.col("group").alias("_language"), "digest")
    nodes = cut_lineage(numbered(nodes, "_language"), "merkle-languages")
    levels = rounds(nodes, block)
    parents = levels[-1].select("group", "place", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                                F.lit("").alias("steps"), F.lit("").alias("siblings"))
    for level in reversed(levels[:-1]):
        parents = cut_lineage(extended(level, parents, block), "merkle-witness")
    return parents.drop("group", "subroot").join(nodes.select("place", "_language", "digest"), "place").select(
        F.col("_language").alias("group"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root",
        "steps", "siblings")


def manifest(docs: DataFrame, block: int = BLOCK, witness: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, siblings, proof_sha256, folded_root, verified: one row a row of ``docs``.

    ``siblings`` are the witness's hashes from the leaf upwards, ``steps`` say on which side each stands (``-``: none).
    ``folded_root`` is recomputed from the tampered leaf, where there is one, and the original siblings. Without
    ``witness`` the columns steps and siblings are left out.
    """
    if block < 2 or block & (block - 1):
        raise ValueError("a block must be a power of two, 2 at least")
    key = docs.schema["doc_id"].dataType.simpleString()
    nodes = cut_lineage(numbered(leaves(docs), "doc_id", "digest"), "merkle-leaves")
    levels = rounds(nodes, block)
    parents = cut_lineage(language_parents(levels[-1], block), "merkle-parents")
    for level in reversed(levels[1:-1]):
        parents = cut_lineage(extended(level, parents, block), "merkle-witness")
    schema = f"doc_id {key}, leaf string, subroot string, root string, " + (
        "steps string, siblings string, " if witness else "") + "proof_sha256 string, folded_root string, verified boolean"

    def work(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = _ordered(table)
        made = list(_extended(table, parent, block))
        digest, tampered = table.column("digest").to_pylist(), table.column("tampered").to_pylist()
        subroot, root = (parent.column(c)[0].as_py() for c in ("subroot", "root"))
        reached = [folded(t or d, *w) for d, t, w in zip(digest, tampered, made, strict=True)]
        n = len(made)
        shown = {"steps": pa.array([s for s, _ in made], pa.string()), "siblings": pa.array([x for _, x in made], pa.string())}
        return pa.table({"doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([subroot] * n, pa.string()),
                         "root": pa.array([root] * n, pa.string()), **(shown if witness else {}),
                         "proof_sha256": pa.array([hashed(x) for _, x in made], pa.string()),
                         "folded_root": pa.array(reached, pa.string()), "verified": pa.array([r == root for r in reached], pa.bool_())})

    return _meet(nodes, parents, block).applyInArrow(work, schema)
