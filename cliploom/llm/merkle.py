"""Merkle manifest of a dataset: a tree of digests over the rows of each source, and one over the sources.

A level is built by a slot pivot: one conditional aggregate for each of the `fanout` slots spreads the
children of a parent into columns. Concatenating the columns and hashing gives the parent; leaving a
child's own column out gives its siblings. Trees are walked up once for the digests and down once for
the paths, each level a sixteenth of the one below, so no task sees more than its share of one level.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import numbered, settled, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*given: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated values."""
    return F.sha2(F.concat(*given).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """A row's digest: each field as `-` if null, else its number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


@dataclass
class Tree:
    """Trees of several groups. runs[k] (grp, node, c0, c1, ...): the children of each node that is made from
    level k, as structs that begin with `hash`; ends[k] (grp, c0): the groups whose root stands on level k."""

    runs: list[DataFrame]
    ends: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [e.select("grp", F.col("c0.hash").alias("hash")) for e in self.ends])


def _joined(slots: Iterable[int]) -> str:
    """SQL for the digests in some slots, one after another."""
    return f"concat_ws('', {', '.join(f'c{i}.hash' for i in slots) or chr(39) * 2})"


def grow(nodes: DataFrame, carried: list[str], fanout: int, name: str) -> Tree:
    """The trees over nodes (grp, pos, hash, *carried): places from 0 without gaps in each group."""
    most = nodes.agg(F.max("pos")).first()[0] or 0
    tree = Tree([], [], fanout)
    while most > 0:
        child = f"struct({', '.join(['hash', *carried])})"
        pivot = [F.expr(f"max(CASE WHEN pmod(pos, {fanout}) = {i} THEN {child} END) AS c{i}") for i in range(fanout)]
        level = nodes.groupBy("grp", F.expr(f"pos div {fanout}").alias("node")).agg(*pivot)
        level = stored(level, f"{name}-{len(tree.runs)}")
        alone = F.expr("node = 0 AND c1 IS NULL")  # a group that has one node left
        tree.ends.append(level.filter(alone).select("grp", "c0"))
        tree.runs.append(level.filter(~alone))
        nodes = tree.runs[-1].select("grp", F.col("node").alias("pos"), F.expr(f"sha2(CAST({_joined(range(fanout))} AS BINARY), 256) AS hash"))
        carried, most = [], most // fanout
    tree.ends.append(nodes.select("grp", F.struct("hash", *carried).alias("c0")))
    return tree


def descend(tree: Tree, above: DataFrame, what: list[str], name: str) -> DataFrame:
    """(grp, pos, child, path, *what) of every node of the lowest level: child is its struct, path the
    (left, right) siblings level by level up to the root, followed by the path `above` (grp, path, *what)
    has for its group."""
    n = tree.fanout
    each = ", ".join(f"struct(c{i} AS child, {_joined(range(i))} AS left, {_joined(range(i + 1, n))} AS right)" for i in range(n))
    whole = None
    for k in reversed(range(len(tree.ends))):
        at_root = tree.ends[k].join(above, "grp").select("grp", F.lit(0).cast("long").alias("pos"), F.col("c0").alias("child"), "path", *what)
        if whole is None:
            whole = at_root
            continue
        known = whole.select("grp", F.col("pos").alias("node"), "path", *what)
        if k < len(tree.runs) - 1:
            known = stored(known, f"{name}-{k + 1}")
        step = tree.runs[k].join(known, ["grp", "node"]).select("grp", "node", "path", *what, F.expr(f"posexplode(array({each})) AS (slot, own)"))
        step = step.filter("own.child IS NOT NULL").select(
            "grp",
            F.expr(f"node * {n} + slot AS pos"),
            "own.child",
            F.expr("concat(array(struct(own.left, own.right)), path) AS path"),
            *what,
        )
        whole = at_root.unionByName(step)
    return whole


def proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", received: dict[str, Column] | None = None, fanout: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, leaf, given, subroot, root, path.

    Rows are leaves, in each group by `order` (then by digest); every `fanout` consecutive nodes of a
    level become their digest until a group has one, its subroot; the subroots, by group, null first,
    become the root likewise. path holds (left, right) for each level from the leaf's to the root's: the
    digests of the run's other nodes before and after the own one. given is the digest of the row with
    the columns that `received` has instead, null where nothing is received. A null group is a group, apart from
    the empty name; null ids come first; repeated rows are leaves of their own; no rows give no rows.
    """
    grp = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    plain = [F.col(f) for f in fields]
    sent = [(received or {}).get(f, F.col(f)) for f in fields]
    spark = docs.sparkSession

    def made() -> DataFrame:
        rows = docs.select(grp.alias("grp"), F.col(order).alias("ord"), F.col("doc_id"), leaf(plain).alias("hash"), (leaf(sent) if received else F.lit(None).cast("string")).alias("given"))
        rows = numbered(stored(rows, "leaves"), ["grp"], ["ord", "hash"], "leaf-order")
        lower = grow(rows, ["given", "doc_id"], fanout, "merkle")
        tops = stored(lower.roots().select(F.lit("").alias("grp"), F.col("grp").alias("own"), "hash"), "subroots")
        upper = grow(numbered(tops, ["grp"], ["own"], "subroot-order"), ["own"], fanout, "merkle-top")
        start = upper.roots().select("grp", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        above = descend(upper, start, ["root"], "top-paths")
        above = stored(above.select(F.col("child.own").alias("grp"), "path", F.col("child.hash").alias("subroot"), "root"), "paths")
        return descend(lower, above, ["subroot", "root"], "leaf-paths").select("child.doc_id", F.col("child.hash").alias("leaf"), "child.given", "subroot", "root", "path")

    return settled(spark, made, "proofs")


def siblings(path: str = "path") -> Column:
    """All siblings along a path, one after another."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda done, x: F.sha2(F.concat(x["left"], done, x["right"]).cast("binary"), 256))


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the rows of proofs(): the root is
    recomputed from what was received, else from the leaf, and compared."""
    again = folded(F.coalesce("given", "leaf"))
    rows = found.select("doc_id", "leaf", "subroot", "root", digest(siblings()).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
