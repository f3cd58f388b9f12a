"""Connected components of a distributed edge list, by alternating large and small stars.

Edges are first thinned to spanning forests, a bounded number at a time: an edge between nodes that
others of its task connect already adds nothing. The rounds end as soon as the edges are stars.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import materialize, tidied

FOREST_EDGES = 32_768  # edges that a task thins at once


class Joined(dict):
    """The node above each node but the smallest of those that joins have connected."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Connects two nodes; whether they were not connected yet."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def spanning(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that pairs connect with each node, for all nodes but that one."""
    above = Joined()
    for a, b in pairs:
        above.join(a, b)
    return {x: above.root(x) for x in list(above)}


def forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect the same nodes as ``edges`` (a, b; a table).

    The edges of a node ``a`` meet in one task, which takes them in bounded lots.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def thin(batches):
        held: list[tuple[int, int]] = []

        def out():
            found = spanning(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"u": list(found), "v": list(found.values())}, schema=schema)
        for batch in batches:
            held += zip(*(column.to_pylist() for column in batch.columns))
            if len(held) >= FOREST_EDGES:
                yield out()
        yield out()

    tasks = max(1, -(-edges.count() // FOREST_EDGES))
    return edges.repartition(tasks, "a").mapInArrow(tidied(thin), "u long, v long").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to its centre."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
            .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")))
    return ends.filter("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (a, b).

    Each round is joins and pre-aggregated minima, so a node with very many neighbours is
    no hot task; the edge list is written after each round, which cuts the lineage.
    """
    edges = materialize(forests(materialize(edges.filter("a != b").select("a", "b").distinct(), f"{label}-all")), label)
    while not are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest).distinct())
        edges = materialize(small, label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())


def merged_components(known: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The components of the nodes of ``known`` (node, component) and of links (a, b) between them or
    with further nodes; only the links are worked on anew."""
    of = known.select(F.col("node").alias("n"), F.col("component").alias("c"))
    for end in ("a", "b"):
        links = links.join(of, F.col(end) == F.col("n"), "left").withColumn(f"c{end}", F.coalesce("c", end)).drop("n", "c")
    links = materialize(links, f"{label}-ends")
    above = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), label)
    fresh = (links.select(F.col("a").alias("node"), F.col("ca").alias("component"))
             .union(links.select("b", "cb")).distinct())
    return (known.union(fresh).distinct()
            .join(above.select(F.col("node").alias("n"), F.col("component").alias("c")), F.col("component") == F.col("n"), "left")
            .select("node", F.coalesce("c", "component").alias("component")))
