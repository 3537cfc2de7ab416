"""Connected components of links, by alternating star contractions.

A contraction needs the least neighbour of every node: one aggregation, combined before its
shuffle, so a node may have any number of links. The links then look their node's answer up;
nodes with very many links are answered by a small broadcast (``common.lookup``), so that no
node's links gather in one task. A round is two contractions, written to the shared folder;
nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import lookup, materialise
from tabloom.sources.store import forget


def _star(edges: DataFrame, large: bool, total: int, heavy_links: int) -> DataFrame:
    """One contraction of edges (a, b) with a > b, to edges (a, b) with a > b.

    Large: every node hands its larger neighbours to the least of its neighbourhood. Small:
    every node hands its smaller neighbours, and itself, to the least of them.
    """
    rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        rows = rows.unionAll(edges.select("b", "a"))
    least = F.least(F.min("v"), F.col("u")) if large else F.min("v")
    nodes = rows.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    known = lookup(rows, nodes, "u", "n", total * (2 if large else 1), heavy_links)
    found = known.where(F.col("v") > F.col("u") if large else F.col("v") > F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        found = found.unionAll(nodes.select("u", "m"))
    return found.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", heavy_links: int = 1_000) -> DataFrame:
    """node and root (the least node of its component) for every node of a link; links are integers in either order.

    Null ends and links of a node to itself are no links; links may repeat.
    """
    x, y = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    now = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y))
    mark, total = None, now.count()
    while True:
        now = materialise(_star(materialise(_star(now, True, total, heavy_links), "links"), False, total, heavy_links), "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or (seen.n, seen.h) == mark:
            # every link now leads from a node to its root, once
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        mark, total = (seen.n, seen.h), seen.n
        forget(edges.sparkSession)
