"""Merkle manifest of a dataset: a tree of digests by group, a tree over the groups, and proofs.

A level is made by one window over the nodes of the level below, partitioned by
group and parent: the ordered list of a run's digests is the parent's preimage and
holds every node's siblings.  One row a parent goes on to the next level.  Proofs
come back down: a node's path is its own run's siblings, then its parent's path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered, same_values
from .storage import durable

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(preimage: Column) -> Column:
    """SHA-256 in lower-case hex of a string's UTF-8 bytes."""
    return F.sha2(preimage.cast("binary"), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value; so no two rows have one preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*(field_text(v) for v in values)))


@dataclass
class Tree:
    """Durable levels of ``by…, position, size, digest, children``; the first holds leaves and has no children."""

    levels: list[DataFrame]
    by: list[str] = field(default_factory=list)
    fanout: int = FANOUT

    def tops(self) -> DataFrame:
        """``by…, digest``: the last node of every group."""
        out = None
        for level in self.levels:
            top = level.filter("size = 1").select(*self.by, "digest")
            out = top if out is None else out.unionByName(top)
        return out


def grow(nodes: DataFrame, by: list[str], fanout: int = FANOUT) -> Tree:
    """The tree over durable nodes ``by…, position, size, digest``; groups of one node are done."""
    tree = Tree([nodes], by, fanout)
    while True:
        below = tree.levels[-1].filter("size > 1")
        if below.isEmpty():
            return tree
        run = Window.partitionBy(*by, "parent").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        framed = below.withColumn("parent", F.floor(F.col("position") / fanout)).withColumn("children", F.collect_list("digest").over(run))
        parents = framed.filter(F.col("position") % fanout == 0)  # the first child stands for its parent: one row each
        above = parents.select(*by, F.col("parent").alias("position"), F.ceil(F.col("size") / fanout).alias("size"), digest(F.array_join("children", "")).alias("digest"), "children")
        tree.levels.append(durable(above))


def _step(position: Column, children: Column, fanout: int) -> Column:
    """What stands before and after a node in its run."""
    at = (position % fanout).cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"), F.array_join(F.slice(children, at + 2, F.lit(fanout)), "").alias("after"))


def paths(tree: Tree, tops: DataFrame | None, *, keep: list[str] | None = None) -> DataFrame:
    """``by…, digest, path, subroot, root`` and the kept columns of every leaf; ``tops`` has ``by…, path, subroot, root`` of every group; without it, the last node is the root."""
    above = None
    for number, level in reversed(list(enumerate(tree.levels))):
        kept = (keep or []) if number == 0 else ["children"]
        own = [*tree.by, "position", "digest", *kept]
        done = level.filter("size = 1").select(*own)
        if tops is None:
            out = done.select(*own, F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        else:
            named = tops.select(*(F.col(c).alias(f"_{c}") for c in tree.by), "path", "subroot", "root")
            out = done.join(named, same_values({c: f"_{c}" for c in tree.by})).select(*own, "path", "subroot", "root")
        if above is not None:
            nodes = level.filter("size > 1").select(*own, F.floor(F.col("position") / tree.fanout).alias("_parent"))
            up = above.select(*(F.col(c).alias(f"_{c}") for c in tree.by), F.col("position").alias("_position"), F.col("children").alias("_children"), F.col("path").alias("_path"), "subroot", "root")
            on = same_values({"_parent": "_position"} | {c: f"_{c}" for c in tree.by})
            path = F.concat(F.array(_step(F.col("position"), F.col("_children"), tree.fanout)), F.col("_path"))
            out = out.unionByName(nodes.join(up, on).select(*own, path.alias("path"), "subroot", "root"))
        above = out
    return above.drop("position")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda below, x: digest(F.concat(x["before"], below, x["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


@dataclass
class Manifest:
    """Trees of the groups and the tree over their subroots."""

    groups: Tree
    top: Tree

    def proofs(self) -> DataFrame:
        """Every leaf's ``group, digest, path, subroot, root`` and its kept columns.

        ``path`` is an array of (before, after): the concatenated digests that stand
        before and after the node in its run, from the leaf up to the root.
        """
        leaves = self.groups.levels[0]
        kept = [c for c in leaves.columns if c not in ("group", "position", "size", "digest")]
        above = paths(self.top, None, keep=["group"]).select("group", "path", F.col("digest").alias("subroot"), "root")
        return paths(self.groups, above, keep=kept)


def build(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, claims: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table: leaves by id within their group, groups by value, runs of ``fanout`` nodes.

    A leaf is the digest of ``columns``, nulls told apart from empty texts; whole texts
    of any length count.  Null ids come first, rows of one id stand in the order of their
    digests (so any order of equal rows gives one tree); a null group is a group and
    comes first.  A group of one row is its own subroot; a single subroot is the root.
    ``claims`` are columns worked out from the same rows and kept beside the leaves (at
    most some digests).  Other columns are ignored, whatever their names; an empty table
    has no leaves and no root.
    """
    claims = claims or {}
    row = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *(c.alias(f"claim_{n}") for n, c in claims.items()), F.monotonically_increasing_id().alias("row"))
    leaves = durable(row)  # written with their numbers, so that texts are read once and equal rows stay apart
    order = [F.col("id"), F.col("digest"), F.col("row")]
    groups = grow(durable(numbered(leaves, order, ["group"]).drop("row")), ["group"], fanout)
    top = grow(durable(numbered(groups.tops(), [F.col("group").asc_nulls_first()])), [], fanout)
    return Manifest(groups, top)
