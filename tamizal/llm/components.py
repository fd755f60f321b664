"""Problem 1: consolidating pairwise matches into groups.

Union-find runs inside bounded blocks of edges and keeps one spanning forest per block (node -> smallest
node of its tree). Nodes that occur in several forests tie trees together; the ties form a contracted
edge set over tree roots only, which is solved the same way with fewer partitions, level by level, until a
level fits one bounded block. Labels then flow back from the last level to the first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold

from .common import Scratch, maybe_broadcast, names_something

#: Edges of one union-find block; what one task holds at a time.
BLOCK_EDGES = 400_000


def _forest(a: pd.Series, b: pd.Series) -> tuple[pd.Index, list[int]]:
    """Union-find over one block: the distinct nodes in ascending order and the root's position of each."""
    both = pd.concat([a, b], ignore_index=True)
    codes, nodes = pd.factorize(both, sort=True)
    n = len(a)
    parent = list(range(len(nodes)))
    for x, y in zip(codes[:n].tolist(), codes[n:].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # parents are smaller than their children, so one ascending pass flattens
        parent[i] = parent[parent[i]]
    return nodes, parent


def _blocks(batches, size: int):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= size:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _forests(block_edges: int, with_edges: bool):
    def run(batches):
        for block in _blocks(batches, block_edges):
            if not len(block):
                continue
            nodes, root = _forest(block["a"], block["b"])
            names = nodes[root]
            yield pd.DataFrame({"edge": pd.array([None] * len(nodes), dtype="Int64"), "node": nodes, "root": names})
            if with_edges:
                at = pd.Series(names, index=nodes).reindex(block["a"]).to_numpy()
                yield pd.DataFrame({"edge": block["edge"].astype("Int64"), "node": None, "root": at})

    return run


FOREST = "edge long, node string, root string"


def _ties(forest: DataFrame) -> DataFrame:
    """(root, a): each tree root of a node beside the node's smallest tree root."""
    return (
        forest.withColumn("least", F.min("root").over(Window.partitionBy("node")))
        .where("root <> least")
        .select(F.col("root").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def solve(scratch: Scratch, edges: DataFrame, block_edges: int = BLOCK_EDGES, level: int = 0) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    ``edges`` must be a kept table. A level of at most ``block_edges`` edges is one block and exact; a larger
    one is cut into random blocks. Nodes are renamed by a hash that changes with the level, so that chains in
    name order shrink by a constant share per level too.
    """
    n = edges.count()
    if n <= block_edges:
        one = edges.select(F.lit(None).cast("long").alias("edge"), "a", "b").coalesce(1)
        return scratch.keep(one.mapInPandas(_forests(block_edges + 1, False), FOREST).select("node", F.col("root").alias("label")), f"solved{level}")
    rank = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(F.lit(level), c)), 16, "0"), c)
    blocks = -(-n // block_edges)
    mixed = edges.select(F.lit(None).cast("long").alias("edge"), rank(F.col("a")).alias("a"), rank(F.col("b")).alias("b")).repartition(blocks)
    forest = scratch.keep(mixed.mapInPandas(_forests(block_edges * 2, False), FOREST).select("node", "root"), f"forest{level}")
    ties = scratch.keep(_ties(forest), f"ties{level}")
    upper = solve(scratch, ties, block_edges, level + 1)
    trees = forest.groupBy("node").agg(F.min("root").alias("root"))
    rooted = trees.join(maybe_broadcast(upper.withColumnRenamed("node", "root")), "root", "left").select(
        "node", F.coalesce("label", "root").alias("tree")
    )
    # back from ranks to names: the smallest name of each tree labels it
    named = rooted.select(F.substring("node", 17, 1 << 30).alias("node"), "tree")
    least = named.groupBy("tree").agg(F.min("node").alias("label"))
    return scratch.keep(named.join(least, "tree").select("node", "label"), f"solved{level}")


def group_edges(pairs: DataFrame, edge: str, a: str, b: str, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(edge, group): one row per pair, ``group`` the smallest name linked to it directly or indirectly.

    Rows whose ``a`` or ``b`` is null make no pair and have no result. Repeated pairs, pairs of a name with
    itself and ties are ordinary; an empty table gives an empty result; other columns are ignored. Each block
    of at most ``block_edges`` pairs is one union-find in a task; nothing is gathered in the driver.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    edges = pairs.select(F.col(edge).cast("long").alias("edge"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    first = scratch.keep(edges.mapInPandas(_forests(block_edges, True), FOREST), "first")
    ties = scratch.keep(_ties(first.where("node is not null")), "ties")
    labels = solve(scratch, ties, block_edges)
    found = first.where("node is null").select("edge", "root")
    return found.join(maybe_broadcast(labels.withColumnRenamed("node", "root")), "root", "left").select(
        "edge", F.coalesce("label", "root").alias("group")
    )


def alias_groups(claims: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(claim_id, group_name) of every alias claim whose two names both name something.

    Null, blank and placeholder names are no names: such claims have no row. A claim of a name to itself is a
    group of its own. Names are compared folded.
    """
    a, b = fold(F.col("alias")), fold(F.col("canonical_name"))
    pairs = claims.select("claim_id", a.alias("a"), b.alias("b")).where(names_something(F.col("a")) & names_something(F.col("b")))
    return group_edges(pairs, "claim_id", "a", "b", block_edges).select(F.col("edge").alias("claim_id"), F.col("group").alias("group_name"))


def link(scratch: Scratch, pairs: DataFrame, a: str, b: str, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, label) for string-cast ids: the same solver for pairs made by other operators."""
    edges = scratch.keep(pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")), "edges")
    return solve(scratch, edges, block_edges)


def rank_of(c: Column) -> Column:
    """Numbers as strings that sort like the numbers."""
    return F.lpad(c.cast("string"), 20, "0")
