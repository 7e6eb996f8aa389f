"""Merkle dataset manifest with octopus multiproofs.

Leaves are digests of rows. Those of one language, in order of id, are the leaves of a tree, and the roots of these trees are the
leaves of the tree above them. Positions come from a range sort and the counts of its partitions, so a language
that holds most rows is no single task's work. Trees grow a block of 2 ** DEPTH leaves at a time, then blocks of such blocks.

For proofs, a partition is one block of leaves. It computes the coordinates of the nodes that all its proofs together need
and its own leaves cannot give, fetches each of them once by a join, derives the nodes inside from its leaves, and writes out every
leaf's proof from what it then has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import NULL_ID, cut, real_id

#: Levels that a block of leaves spans.
DEPTH = 12
#: The number of the tree over the roots of the others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sealed(*values: Column) -> Column:
    """The digest of fields: each its UTF-8 bytes after their number and a colon, or a dash for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def depth(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def missing(index: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, place) of every node that the proofs of the leaves `index` (ascending) of n leaves need and these leaves do not give."""
    out, level = [], 0
    while n > 1:
        beside = np.setdiff1d(index ^ 1, index)
        out += [(level, int(i)) for i in beside[beside < n]]
        index, n, level = np.unique(index >> 1), (n + 1) // 2, level + 1
    return out


class Branch:
    """The nodes over a run of leaves: those that the run gives, derived once, and those fetched."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.rows, self.fetched = [(first, leaves, n)], fetched
        while n > 1:
            low, high = first >> 1, (first + len(leaves) - 1) >> 1
            up = []
            for i in range(low, high + 1):
                left = self.node(len(self.rows) - 1, 2 * i)
                up.append(digest(left, self.node(len(self.rows) - 1, 2 * i + 1)) if 2 * i + 1 < n else digest(left))
            first, leaves, n = low, up, (n + 1) // 2
            self.rows.append((first, leaves, n))
        self.root = leaves[0]

    def node(self, level: int, i: int) -> str:
        first, have, _ = self.rows[level]
        return have[i - first] if first <= i < first + len(have) else self.fetched[level, i]

    def proof(self, i: int) -> list[tuple[str, bool]]:
        """(sibling, whether it stands to the left) of leaf i from the lowest level up; a node alone has none: ("", False)."""
        out = []
        for level, (_, _, n) in enumerate(self.rows[:-1]):
            at = i >> level
            out.append((self.node(level, at ^ 1), bool(at & 1)) if at ^ 1 < n else ("", False))
        return out


def folded(leaf: str, proof: list[tuple[str, bool]]) -> str:
    for sibling, left in proof:
        leaf = digest(sibling, leaf) if left else digest(leaf, sibling)
    return leaf


@dataclass
class Manifest:
    """leaves: (id, tree, n, pos, leaf, claimed). nodes: (tree, level, place, hash), of the trees of languages from level DEPTH
    up. trees: (tree, n, hash) by language. root: of all, null for an empty table. n: number of trees."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    n: int


def _grow(level: int, inner: bool, blocks: int):
    """A function for applyInArrow: of nodes of one level in one block, those above them, up to `blocks` levels; without inner the highest alone."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        tree, n, at, row = t["tree"][0].as_py(), t["n"][0].as_py(), t["place"][0].as_py(), t["hash"].to_pylist()
        out, last = [], min(level + blocks, depth(n))
        for now in range(level, last + 1):
            if now > level:
                row, at = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)], at >> 1
            if now == last or (inner and now > level):
                out += [(tree, n, now, at + i, h, now == depth(n)) for i, h in enumerate(row)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], NODE)

    return run


NODE = ["tree", "n", "level", "place", "hash", "root"]
_NODES = "tree long, n long, level int, place long, hash string, root boolean"


def _tiers(leaves: DataFrame, largest: int, inner: bool, blocks: int) -> list[DataFrame]:
    """Nodes of trees by tier, a tier spanning `blocks` levels. leaves: tree, n, place, hash. The first tier has its highest level alone unless inner."""
    out, level, now = [], 0, leaves
    while True:
        block = F.shiftright("place", blocks).alias("block")
        got = cut(now.groupBy("tree", block).applyInArrow(_grow(level, inner or level > 0, blocks), _NODES), "tier")
        out.append(got)
        level += blocks
        if depth(largest) <= level:
            return out
        now = got.where((F.col("level") == level) & ~F.col("root")).select("tree", "n", "place", "hash")


def build(leaves: DataFrame, blocks: int = DEPTH) -> Manifest:
    """The manifest of leaves (key, id, leaf, claimed): trees by key in order of key, leaves in order of id, then of leaf."""
    spark = leaves.sparkSession
    order = ["key", "id", "leaf", "row"]
    rows = cut(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    place = F.monotonically_increasing_id()  # a partition's number above 33 bits of the row's place in it
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place).drop("row"), "ordered")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    runs = cut(rows.groupBy(part.alias("part"), "key").agg(F.count("*").alias("c"), F.min(within).alias("low")), "runs")
    # keys are numbered by the partitions that they begin in: one row per partition, then one per key
    keys = runs.groupBy("key").agg(F.min("part").alias("part"), F.sum("c").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = keys.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    keys = cut(keys.withColumn("number", number).join(begin, "part").select("key", "n", (F.col("base") + F.col("number")).cast("long").alias("tree")), "keys")
    of_key = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("c").over(of_key), F.lit(0)) - F.col("low")).join(keys, "key").select("part", "key", "start", "n", "tree")
    placed = rows.withColumn("part", part).join(starts, ["part", "key"]).select("id", "tree", "n", (F.col("start") + within).alias("pos"), "leaf", "claimed")
    placed = cut(placed, "placed")
    n, largest = keys.agg(F.count("*"), F.max("n")).first()
    if not n:
        return Manifest(placed, spark.createDataFrame([], "tree long, level int, place long, hash string"), keys.select("key", "tree", "n", F.lit("").alias("hash")), None, 0)
    below = _tiers(placed.select("tree", "n", F.col("pos").alias("place"), F.col("leaf").alias("hash")), largest, False, blocks)
    every = below[0]
    for tier in below[1:]:
        every = every.unionAll(tier)
    subroots = every.where("root").select("tree", "hash")
    roots = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("place"), "hash")
    nodes = every.select("tree", "level", "place", "hash").unionAll(roots.select("tree", F.lit(0).alias("level"), "place", "hash"))
    root = None
    if n == 1:
        root = roots.first()["hash"]
    else:
        above = _tiers(roots, n, True, blocks)
        for tier in above:
            nodes = nodes.unionAll(tier.select("tree", "level", "place", "hash"))
        root = above[-1].where("root").first()["hash"]
    return Manifest(placed, nodes, keys.join(subroots, "tree").select("key", "tree", "n", "hash"), root, n)


def prove(manifest: Manifest, blocks: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, missing) of every leaf, with the root that its claimed digest folds to."""
    n_trees, root = manifest.n, manifest.root
    block = F.shiftright("pos", blocks)
    here = manifest.leaves.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"))

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                own = np.arange(x["block"] << blocks, min(x["n"], (x["block"] + 1) << blocks))
                out += [(x["tree"], x["block"], x["tree"], level, i) for level, i in missing(own, x["n"])]
                out += [(x["tree"], x["block"], TOP, level, i) for level, i in missing(np.array([x["tree"]]), n_trees)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["for_tree", "block", "tree", "level", "place"])

    wanted = here.select("tree", "block", "n").mapInArrow(coordinates, "for_tree long, block long, tree long, level int, place long")
    # upper nodes are wanted by many blocks; both sides are shuffled, so that adaptive execution can split such a node's rows
    fetched = wanted.join(manifest.nodes, ["tree", "level", "place"]).select(F.col("for_tree").alias("tree"), "block", F.col("tree").alias("in_tree"), "level", "place", "hash")

    def expand(leaves: pa.Table, got: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        tree, n, first = leaves["tree"][0].as_py(), leaves["n"][0].as_py(), leaves["pos"][0].as_py()
        known: dict[bool, dict] = {False: {}, True: {}}
        for t, level, i, h in zip(*(got[c].to_pylist() for c in ("in_tree", "level", "place", "hash"))):
            known[t == TOP][level, i] = h
        own, claimed = leaves["leaf"].to_pylist(), leaves["claimed"].to_pylist()
        low = Branch(first, own, n, known[False])
        high = Branch(tree, [low.root], n_trees, known[True])
        if high.root != root:
            raise ValueError(f"block {first >> blocks} of tree {tree} does not give the root of the manifest")
        above, out = high.proof(tree), []
        for i, (leaf, claim) in enumerate(zip(own, claimed), first):
            proof = low.proof(i) + above
            back = root if claim == leaf else folded(claim, proof)
            out.append((low.root, root, digest(*[s for s, _ in proof]), back, back == root))
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        return pa.Table.from_arrays([leaves["id"], leaves["leaf"], *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], NAMES)

    grouped = manifest.leaves.withColumn("block", block).groupBy("tree", "block")
    return grouped.cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


NAMES = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def verify_documents(docs: DataFrame, tampered: Column | None = None, blocks: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    A row where `tampered` holds (by default: 7 divides the CRC-32 of its decimal id) is claimed with n_chars one higher; its claimed leaf is folded with the
    original siblings. Nulls are sealed as such, so a null text is no empty one, and a null n_chars or id is not tampered with;
    texts of any length are sealed whole. A null id comes first in its language and a null language before the others. Rows that share an id
    stand in order of their leaves; repeated rows are leaves each. An empty table gives an empty one; columns besides FIELDS are not read.
    """
    id_, n = F.col("doc_id"), F.col("n_chars")
    if tampered is None:
        tampered = F.crc32(id_.cast("string").cast("binary")) % 7 == 0
    other = [id_, F.col("source"), F.col("lang"), F.when(tampered, n.cast("decimal(20,0)") + 1).otherwise(n.cast("decimal(20,0)")), F.col("text")]
    leaves = docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("s"), "lang")).alias("key"),
        F.coalesce(id_.cast("long"), F.lit(NULL_ID)).alias("id"),
        sealed(*[F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(tampered & n.isNotNull(), sealed(*other)).alias("claimed"),
    )
    leaves = leaves.withColumn("claimed", F.coalesce("claimed", "leaf"))
    return prove(build(leaves, blocks), blocks).withColumn("doc_id", real_id("id")).select("doc_id", *NAMES[1:])
