"""Links between items that share keys, without all pairs of a key's list, and the groups that links form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliotab.llm.nodes import bitmap
from foliotab.session import cut_lineage

HUBS = 64
KEY_BITS = 1 << 24


def groups(links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b) between long ids: rows (node, root), root the smallest id reachable.

    Alternates two star steps until the links no longer change: every node passes its smallest neighbour to its larger
    neighbours, then to all its smaller ones. A node's neighbours are never gathered; they are only reduced to their
    minimum and joined with it, and Spark splits that join where one node has many neighbours.
    """
    edges = cut_lineage(_oriented(links))
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before or not now[0]:
            break
        before = now
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
    roots = edges.select(F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges with a > b."""
    if large:
        near = edges.select("a", "b").union(edges.select("b", "a"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def linked_groups(postings: Callable[[bytes | None], DataFrame], near: Callable, verify: Callable[[DataFrame], DataFrame], family: bool = True, same: tuple[str, ...] = ()) -> DataFrame:
    """Components (node, root) of all links between nodes that share a key.

    ``postings(None)`` gives all rows (key, prio). ``postings(marks)`` gives rows (key, node, prio, ...), at least of the keys
    whose last bits are set in ``marks``; so keys that one node has are dropped before they are shuffled. ``near(mine,
    other)`` is a condition that no link fails; ``mine`` and ``other`` name a column of either row. ``verify`` maps distinct
    pairs (a, b) to the linked ones.

    A list of n nodes never makes n * n pairs at once. First each node is compared with its list's hub (the smallest
    ``prio``). Nodes near a common hub, directly or over others, are a family. A family's nodes share many lists, so each
    family becomes one list of its own, and the lists it came from only serve pairs of different families. Then only
    lists that still hold nodes of different components are left; in each round their next ``HUBS`` nodes (eight times as
    many each round) are compared with the rest of other components, and leave the list. It ends when no list joins two
    components any more, so no link between two components is lost. Without ``family`` nodes stay in their lists; that
    suits a ``near`` that depends on the key, or that many unlinked nodes pass. ``same`` names columns that describe a node,
    not its place in a list; rows that differ in them stay apart in a family's list.
    """
    lists = postings(None).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("prio").alias("first_prio"))
    lists = cut_lineage(lists.where("n > 1").drop("n"))
    marks = bitmap(lists, F.col("key").bitwiseAND(F.lit(KEY_BITS - 1)), KEY_BITS)
    shared = cut_lineage(postings(marks).join(lists, "key"))
    columns = [c for c in shared.columns if c not in ("key", "first_prio")]
    mine, other = (lambda c: F.col(c)), (lambda c: F.col(f"hub_{c}"))
    as_hubs = lambda rows, *more: rows.select("key", *[F.col(c).alias(f"hub_{c}") for c in (*columns, *more)])
    first = shared.join(as_hubs(shared.where("prio = first_prio")), "key").where((F.col("node") != F.col("hub_node")) & near(mine, other))
    first = cut_lineage(_pairs(first))
    links = [cut_lineage(verify(first))]
    if family:
        rest = cut_lineage(_by_family(shared, first, columns, same))
    else:
        rest = shared.where("prio <> first_prio").select("key", *columns, F.col("node").alias("fam"))
    return spread(links, rest, near, verify)


def spread(links: list[DataFrame], rest: DataFrame, near: Callable, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) of the links known and of all those in the lists ``rest`` (key, node, prio, fam, ...).

    In each round the next hubs of the lists that hold several components are compared with the rest of other families.
    """
    links = list(links)
    columns = [c for c in rest.columns if c != "key"]
    mine, other = (lambda c: F.col(c)), (lambda c: F.col(f"hub_{c}"))
    as_hubs = lambda rows, *more: rows.select("key", *[F.col(c).alias(f"hub_{c}") for c in (*columns, *more)])
    hubs = HUBS
    while True:
        found = reduce(DataFrame.unionByName, links)
        roots = groups(found)
        known = rest.drop("comp").join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        rest = cut_lineage(known.join(mixed, "key", "left_semi").select("key", *columns, "comp"))
        if rest.isEmpty():
            return roots
        ranked = Window.partitionBy("key").orderBy("prio", "node")
        top = rest.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= hubs)
        top = cut_lineage(as_hubs(top, "comp"))
        both = rest.join(top, "key").where("comp <> hub_comp and fam <> hub_fam and (prio, node) > (hub_prio, hub_node)").where(near(mine, other))
        links.append(cut_lineage(verify(cut_lineage(_pairs(both)))))
        last = top.groupBy("key").agg(F.max(F.struct("hub_prio", "hub_node")).alias("last"))
        rest = rest.join(last, "key").where(F.struct("prio", "node") > F.struct("last.hub_prio", "last.hub_node")).drop("last")
        hubs *= 8


def _by_family(shared: DataFrame, first: DataFrame, columns: list[str], same: tuple[str, ...]) -> DataFrame:
    """A list for each family, and what is left of the lists that hold several families."""
    families = groups(first).withColumnRenamed("root", "fam")
    own = shared.groupBy("node", *same).agg(*[F.max(c).alias(c) for c in columns if c not in ("node", *same)])
    own = own.join(families, "node").select(F.xxhash64(F.lit("family"), "fam").alias("key"), *columns, F.col("node").alias("fam"))
    rest = shared.where("prio <> first_prio").join(families, "node", "left").select("key", *columns, F.coalesce("fam", "node").alias("fam"))
    apart = rest.groupBy("key").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo < hi").select("key")
    return rest.join(apart, "key", "left_semi").unionByName(own)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
