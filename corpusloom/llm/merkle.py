"""Merkle manifests as an associative monoid of sparse forests.

Leaves are hashed where the rows are read, sorted by range over (group, key), and numbered by
prefix sums of counts; so the width of every level of every tree is known before any node is
made. A fragment of a forest holds the nodes that are not yet under a parent, keyed by tree,
level and index. Adding a node to a fragment completes its run of siblings as soon as as many are
present as the level's width says; the run then gives way to its parent, and so on upward, from a
group's tree into the tree over the groups. Merging two fragments is adding the nodes of one to
the other, in any order: the monoid is associative and commutative, with the empty fragment as
its unit.

Every range of leaves makes one fragment, which keeps a few nodes at its two ends only. Fragments
are reduced as a tree, ``FAN`` neighbouring ones at a time, in written rounds, until the root is
left. Runs that complete are written on the way, with the ranges that lie under them, and
each range then gets the runs above its leaves to make its proofs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: Fragments that a task of a round merges, and leaves of a range, about.
FAN, RANGE_LEAVES = 32, 65_536
#: Counts by range and group up to this many (about 20 MB) are broadcast; more are joined by shuffle.
COUNTS = 500_000
#: The tree over the groups; a group's own tree is named by the group's rank.
TOP = -1

_NODES = "part long, tree long, n long, level int, idx long, digests array<string>, lo long, hi long, open boolean"


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of values, each ``-`` if null, else its UTF-8 byte count, ``:``, itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def hashed(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def width(n: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


class Fragment:
    """A sparse forest. ``done`` gets every run that completes: (tree, level, parent, digests, lo,
    hi), where ``lo`` to ``hi`` are the ranges of leaves under it; ``root`` is the root once known."""

    def __init__(self, groups: int, arity: int, done: Callable | None = None):
        self.groups, self.arity, self.done = groups, arity, done
        self.runs: dict[tuple, dict[int, tuple]] = {}
        self.sizes: dict[int, int] = {}
        self.root: str | None = None

    def add(self, tree: int, n: int, level: int, idx: int, digest: str, lo: int = 0, hi: int = 0) -> None:
        while True:
            wide = width(n, level, self.arity)
            if wide == 1:
                if tree == TOP:
                    self.root = digest
                    return
                tree, n, level, idx = TOP, self.groups, 0, tree
                continue
            parent = idx // self.arity
            run = self.runs.setdefault((tree, level, parent), {})
            run[idx % self.arity] = (digest, lo, hi)
            self.sizes[tree] = n
            if len(run) < min(self.arity, wide - parent * self.arity):
                return
            del self.runs[tree, level, parent]
            nodes = [run[i] for i in range(len(run))]
            digests, lo, hi = [x[0] for x in nodes], min(x[1] for x in nodes), max(x[2] for x in nodes)
            if self.done:
                self.done((tree, level, parent, digests, lo, hi))
            digest, level, idx = hashed(digests), level + 1, parent

    def nodes(self):
        """Nodes without a parent: (tree, leaves of the tree, level, index, digest, lo, hi)."""
        for (tree, level, parent), run in self.runs.items():
            for i, (digest, lo, hi) in run.items():
                yield tree, self.sizes[tree], level, parent * self.arity + i, digest, lo, hi

    def merge(self, other: "Fragment") -> "Fragment":
        for node in other.nodes():
            self.add(*node)
        self.root = self.root or other.root
        return self


def _node_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digests", pa.list_(pa.string())), ("lo", pa.int64()), ("hi", pa.int64()), ("open", pa.bool_())])


def _rows(part: int, fragment: Fragment | None, runs: list) -> list[tuple]:
    """Completed runs, and with them (if a fragment is given) its open nodes and root."""
    rows = [(part, t, 0, level, parent, d, lo, hi, False) for t, level, parent, d, lo, hi in runs]
    if fragment:
        rows += [(part, t, n, level, i, [d], lo, hi, True) for t, n, level, i, d, lo, hi in fragment.nodes()]
        rows += [(part, TOP, 0, -1, 0, [fragment.root], 0, 0, False)] * bool(fragment.root)
    return rows


def _columns(rows: list[tuple]) -> list:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 9, _node_schema())]


def _leaves_to_nodes(groups: int, arity: int):
    """Leaves of some ranges to the nodes and runs of a fragment each."""

    def run(batches):
        fragments, runs = {}, []
        for b in batches:
            for part, tree, n, idx, leaf in zip(*(b.column(i).to_pylist() for i in range(5))):
                if part not in fragments:
                    fragments[part] = Fragment(groups, arity, runs.append)
                fragments[part].add(tree, n, 0, idx, leaf, part, part)
            yield pa.RecordBatch.from_arrays(_columns(_rows(0, None, runs)), schema=_node_schema())
            runs.clear()
        for part, fragment in fragments.items():
            yield pa.RecordBatch.from_arrays(_columns(_rows(part, fragment, [])), schema=_node_schema())

    return run


def _merge_nodes(groups: int, arity: int):
    """The open nodes of neighbouring fragments to those of their sum, and the runs this completes."""

    def run(key, t):
        runs: list = []
        fragment = Fragment(groups, arity, runs.append)
        for tree, n, level, idx, digests, lo, hi in zip(*(t.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digests", "lo", "hi"))):
            fragment.add(tree, n, level, idx, digests[0], lo, hi)
        return pa.Table.from_arrays(_columns(_rows(key[0].as_py(), fragment, runs)), schema=_node_schema())

    return run


@dataclass
class Manifest:
    """Numbered leaves (part, tree, n, idx, leaf and the columns kept), runs of siblings (tree,
    level, parent as idx, digests, lo, hi), the number of groups and the root."""

    leaves: DataFrame
    runs: list[DataFrame]
    groups: int
    root: str | None
    arity: int


def commit(leaves: DataFrame, group: str, key: str, leaf: str, arity: int = 16) -> Manifest:
    """The manifest over rows that hold a leaf digest each, in the order of ``key`` within groups.

    Null groups and null keys come first; rows of one key go by their digests. A third of all rows
    may lie in one group, have one key, or be alike: ranges are cut inside of them.
    """
    spark = leaves.sparkSession
    leaves = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    count = leaves.count()
    if not count:
        return Manifest(leaves, [], 0, None, arity)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_LEAVES))
    order = [F.col(c).asc_nulls_first() for c in (group, key, leaf, "tie")]
    at = F.monotonically_increasing_id()
    ranged = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("tie")
    ranged = materialize(ranged.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "merkle-sorted")
    # the places of ranges in groups, and the ranks of groups: a row for each range and group in it
    counts = ranged.groupBy("part", F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    counts = materialize(counts, "merkle-counts")
    of_group = Window.partitionBy("__group")
    counts = counts.withColumn("base", F.sum("here").over(of_group.orderBy("part")) - F.col("here")).withColumn("n", F.sum("here").over(of_group))
    starts = F.when(F.col("base") == 0, 1).otherwise(0)
    per_part = counts.groupBy("part").agg(F.sum(starts).alias("starts"))
    before = per_part.select("part", (F.sum("starts").over(Window.orderBy("part")) - F.col("starts")).alias("before"))  # a row for each range
    counts = counts.join(F.broadcast(before), "part")
    counts = counts.withColumn("tree", F.col("before") + F.sum(starts).over(Window.partitionBy("part").orderBy("first")) - 1)
    counts = materialize(counts.select(F.col("part").alias("__part"), "__group", "first", "base", "n", "tree"), "merkle-places")
    rows, groups = counts.agg(F.count(F.lit(1)), F.max("tree") + 1).first()
    met = (F.col("part") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group"))
    placed = ranged.join(small(counts, rows, COUNTS), met).withColumn("idx", F.col("base") + F.col("at") - F.col("first")).drop("__part", "__group", "first", "base", "at")
    nodes = placed.select("part", "tree", "n", "idx", leaf).mapInArrow(_leaves_to_nodes(groups, arity), _NODES)
    runs = [materialize(nodes, "merkle-nodes")]
    parts = ranged.agg(F.max("part")).first()[0] + 1
    while parts:
        near = runs[-1].filter("open").withColumn("part", F.floor(F.col("part") / FAN))
        runs.append(materialize(near.groupBy("part").applyInArrow(_merge_nodes(groups, arity), _NODES), "merkle-nodes"))
        parts = 0 if parts <= FAN else -(-parts // FAN)
    root = [r.digests[0] for made in runs for r in made.filter("not open and level = -1").select("digests").collect()]
    return Manifest(placed, [made.filter("not open and level >= 0") for made in runs], groups, root[0], arity)


def prove(m: Manifest, leaf: str, changed: str, kept: list[str]) -> DataFrame:
    """A row per leaf: the columns ``kept``, leaf, subroot, root, proof_sha256 (the digest of its
    siblings, level by level up to the root, left to right), folded_root (from the digest in the
    column ``changed``, else the leaf's own, and the siblings, for every leaf) and verified."""
    kinds = ", ".join(f"`{c}` {m.leaves.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{kinds}{', ' * bool(kinds)}leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if m.root is None:
        return m.leaves.sparkSession.createDataFrame([], schema)
    held = m.leaves.select(*kept, "part", "tree", "n", "idx", F.col(leaf).alias("leaf"), F.col(changed).alias("changed"))
    runs = m.runs[0]
    for more in m.runs[1:]:
        runs = runs.unionAll(more)
    runs = runs.select(F.explode(F.sequence("lo", "hi")).alias("part"), "tree", "level", "idx", "digests")
    arity, groups, root = m.arity, m.groups, m.root

    def of_range(left, right):
        run = {k: d for *k, d in zip(*(right.column(c).to_pylist() for c in ("tree", "level", "idx", "digests"))) for k in [tuple(k)]}
        above: dict[tuple, bytes] = {}
        parents: dict[tuple, str] = {}

        def path(tree, n, idx):
            """Runs above a leaf, from the bottom, with its place in each."""
            out, level = [], 0
            while True:
                while width(n, level, arity) > 1:
                    out.append(((tree, level, idx // arity), idx % arity))
                    level, idx = level + 1, idx // arity
                if tree == TOP:
                    return out
                tree, n, level, idx = TOP, groups, 0, tree

        def others(k, i):
            return "".join(run[k][:i] + run[k][i + 1 :]).encode()

        def digest(k):
            if k not in parents:
                parents[k] = hashed(run[k])
            return parents[k]

        def upward(steps):
            """Siblings of all nodes above the first run of ``steps``."""
            if len(steps) < 2:
                return b""
            k = steps[0][0]
            if k not in above:
                above[k] = others(*steps[1]) + upward(steps[1:])
            return above[k]

        out = []
        for tree, n, idx, mine, other in zip(*(left.column(c).to_pylist() for c in ("tree", "n", "idx", "leaf", "changed"))):
            steps = path(tree, n, idx)
            proof = sha256(others(*steps[0]) if steps else b"")
            proof.update(upward(steps))
            own = [k for k, _ in steps if k[0] != TOP]
            folded = mine if other is None else other
            for k, i in steps:
                folded = hashed(run[k][:i] + [folded] + run[k][i + 1 :])
            out.append((digest(own[-1]) if own else mine, root, proof.hexdigest(), folded, folded == root))
        made = [pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4 + [pa.array([], pa.bool_())]
        return pa.table([left.column(c) for c in (*kept, "leaf")] + made, names=[*kept, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return held.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(of_range, schema)


def manifest(docs: DataFrame, *, doc_id="doc_id", group="source", fields=("doc_id", "source", "lang", "n_chars", "text"), arity=16, changed: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """Leaves, roots and checked proofs of all rows.

    A row is a leaf over ``fields``; a group's leaves ascend by ``doc_id`` and every ``arity``
    consecutive nodes become their digest until one is left, the group's subroot; subroots, by
    group (null first, then bytewise), likewise give the root. ``changed`` holds a condition and
    other values for some fields of the rows that meet it: their folded root starts from the
    changed leaf.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row per row.
    Null fields count as ``-``, empty texts as ``0:``; null groups are a group and null ids come
    first in it; rows of one id go by their digests, so rows alike may be exchanged. A single leaf
    is its own root, with an empty proof. Texts of any length are hashed whole where they are read;
    only digests are shuffled. Other columns are ignored; no rows give no rows.
    """
    where, values = changed or (F.lit(False), {})
    leaves = docs.select(
        F.col(doc_id).alias("id"),
        F.col(group).cast("string").alias("group"),
        leaf_of([F.col(c) for c in fields]).alias("leaf"),
        F.when(where, leaf_of([values.get(c, F.col(c)) for c in fields])).alias("changed"),
    )
    made = commit(leaves, "group", "id", "leaf", arity)
    return prove(made, "leaf", "changed", ["id"]).withColumnRenamed("id", "doc_id")
