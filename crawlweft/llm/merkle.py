"""Merkle dataset manifest by Pregel-style RDD supersteps.

Leaves hash the whole rows (Spark functions); each group of rows (a language) is a tree over its leaves in order, and the trees'
roots are the leaves of the top tree. In an upward superstep the nodes of a level message their parents; a parent whose
children have all reported hashes them and forwards its digest. Messages inside a block of SPAN consecutive nodes stay in
the task that holds the block, so a superstep climbs log(SPAN) levels and n leaves need log(n) / log(SPAN) of them. In
the reverse supersteps every block gets the sibling digests from its top to the root, adds those of its own levels, and broadcasts a
path to each of its children, down to the leaves, which verify themselves by it.

Nodes are dealt by (tree, block): a group of any size is spread over blocks, and no task holds more than a block's digests and paths
at once. Every superstep's nodes are written to the shared folder, so a lost executor costs one superstep. The driver sees counts only.

Defined cases: a null field counts as `-`; null groups are a group of their own and come first; null ids come first in their
group; rows with equal ids are ordered by their leaves; a lone leaf is its tree's root, and a lone tree's root the root; an
empty table gives no rows; columns that aren't named aren't hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import materialize, shuffle_partitions

#: Children of a node, and consecutive nodes of a block: a power of FAN.
FAN, SPAN = 2, 1024
_NODES = "tree long, n long, pos long, digest string"


def digest_of(fields: Sequence[Column]) -> Column:
    """A leaf: sha256 of the fields, each `-` if null, else UTF-8 byte count, colon and value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climbed(block: list[str], n: int, fan: int, span: int) -> list[list[str]]:
    """Levels of a block of consecutive nodes, from its nodes to its top. n: nodes of the whole level; a small one climbs to the root."""
    levels, left, width = [block], n, span
    while width > 1 and left > 1:
        last = levels[-1]
        levels.append([joined(last[i : i + fan]) for i in range(0, len(last), fan)])
        left, width = -(-left // fan), width // fan
    return levels


def siblings(levels: list[list[str]], k: int, fan: int) -> list[str]:
    """The others of node k's runs from level to level, left to right."""
    path = []
    for level in levels[:-1]:
        first = k - k % fan
        path += [d for i, d in enumerate(level[first : first + fan], first) if i != k]
        k //= fan
    return path


def _blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(key, rows) of consecutive rows of one key, in order."""
    for key, group in groupby(rows, itemgetter(0)):
        yield key, [v for _, v in group]


def _dealt(nodes: RDD, parts: int) -> RDD:
    """Pairs ((tree, block, place), value) dealt by (tree, block), sorted."""
    return nodes.repartitionAndSortWithinPartitions(parts, lambda key: hash(key[:2])).map(lambda x: (x[0][:2], (x[0][2], x[1])))


def _up(rows: Iterable[tuple], fan: int, span: int) -> Iterator[tuple]:
    """A superstep: the top of every block, as a node of the level `span` times smaller."""
    for (tree, block), got in _blocks(rows):
        n = got[0][1][0]
        yield tree, -(-n // span), block, climbed([d for _, (_, d) in got], n, fan, span)[-1][0]


def _down(rows: Iterable[tuple], fan: int, span: int) -> Iterator[tuple]:
    """A reverse superstep: the path of every node of a block, from the path of its top."""
    for (tree, _), got in _blocks(rows):
        (path, said), *nodes = (v for _, v in got)
        levels = climbed([x[2] for x in nodes], nodes[0][0], fan, span)
        for k, (n, pos, digest, *own) in enumerate(nodes):
            yield tree, n, pos, digest, own, "".join(siblings(levels, k, fan)) + path, said


def _levels(nodes: DataFrame, fan: int, span: int) -> list[DataFrame]:
    """The nodes of every superstep, the leaves first; the last has one node a tree. nodes: _NODES, n the nodes of its tree."""
    spark, levels = nodes.sparkSession, [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        keyed = levels[-1].rdd.map(lambda r: ((r.tree, r.pos // span, r.pos), (r.n, r.digest)))
        tops = _dealt(keyed, shuffle_partitions(spark)).mapPartitions(lambda rows: _up(rows, fan, span))
        levels.append(materialize(spark.createDataFrame(tops, _NODES, verifySchema=False), "nodes"))
    return levels


def _paths(levels: list[DataFrame], top: RDD, fan: int, span: int) -> RDD:
    """(tree, n, pos, digest, other columns, path, said) of every leaf. top: (tree, (path above the tree's root, what to hand down))."""
    parts = shuffle_partitions(levels[0].sparkSession)
    paths = top.map(lambda x: ((x[0], 0, -1), x[1]))
    for level in reversed(levels[:-1] or levels):
        nodes = level.rdd.map(lambda r: ((r[0], r[2] // span, r[2]), tuple(r[1:])))
        found = _dealt(nodes.union(paths), parts).mapPartitions(lambda rows: _down(rows, fan, span))
        paths = found.map(lambda x: ((x[0], x[2], -1), x[5:]))
    return found


def _numbered(df: DataFrame, schema: str) -> DataFrame:
    """Rows of a sorted table with their numbers (at)."""
    return materialize(df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema, verifySchema=False), "numbered")


def _groups(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all groups' trees with their rows' id, other leaf and group, groups: tree, grp, n)."""
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("other")]
    ranked = _numbered(leaves.select("grp", "id", "leaf", "other").orderBy(*order), f"grp {kinds['grp']}, id {kinds['id']}, leaf string, other string, at long")
    groups = ranked.groupBy("grp").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy(F.col("grp").asc_nulls_first())
    groups = _numbered(groups, f"grp {kinds['grp']}, n long, first long, tree long")
    own = groups.select(F.col("grp").alias("g"), "n", "first", "tree")
    return ranked.join(own, F.col("grp").eqNullSafe(F.col("g"))).select("tree", "n", (F.col("at") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "id", "other"), groups


def folded(leaf: str, pos: int, n: int, path: list[str], fan: int = FAN) -> tuple[str, list[str]]:
    """The root of a tree of n leaves from a leaf at pos and its siblings; the siblings that are left."""
    while n > 1:
        first = pos - pos % fan
        run = min(fan, n - first)
        leaf, path = joined([*path[: pos - first], leaf, *path[pos - first : run - 1]]), path[run - 1 :]
        pos, n = pos // fan, -(-n // fan)
    return leaf, path


def manifest(docs: DataFrame, columns: Sequence[str], *, id_column: str = "doc_id", group: str = "lang", other: Column | None = None, fan: int = FAN, span: int = SPAN) -> DataFrame:
    """One row per row of docs: id_column, leaf, subroot, root, path (siblings' digests one after the other, leaf to root), folded_root, verified.

    columns: what a leaf hashes, in order. folded_root is recomputed by the path from `other` (a leaf as found now) where that isn't null, else from leaf.
    """
    spark = docs.sparkSession
    other = F.lit(None).cast("string") if other is None else other
    leaves = materialize(docs.select(F.col(group).alias("grp"), F.col(id_column).alias("id"), digest_of([F.col(c) for c in columns]).alias("leaf"), other.alias("other")), "leaves")
    nodes, groups = _groups(leaves)
    nodes = materialize(nodes, "nodes")
    levels = _levels(nodes, fan, span)
    # the trees' roots are the leaves of the top tree
    total = groups.count()
    over = _levels(materialize(levels[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"), "tops"), fan, span)
    known = _paths(over, over[-1].rdd.map(lambda r: (r.tree, ("", r.digest))), fan, span)
    found = _paths(levels, known.map(lambda x: (x[2], (x[5], (x[3], x[6], x[2])))), fan, span)  # a tree's path to the root; its root, the root, its place

    def verified(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, n, pos, leaf, (name, now), path, (subroot, root, place) in rows:
            at, rest = folded(now or leaf, pos, n, [path[i : i + 64] for i in range(0, len(path), 64)], fan)
            at, _ = folded(at, place, total, rest, fan)
            yield name, leaf, subroot, root, path, at, at == root

    kind = leaves.schema["id"].dataType.simpleString()
    return spark.createDataFrame(found.mapPartitions(verified), f"{id_column} {kind}, leaf string, subroot string, root string, path string, folded_root string, verified boolean", verifySchema=False)
