"""Connected components of an edge table by large-star and small-star steps.

Each step is one aggregation and one join on node ids; the number of steps grows
with the logarithm of the longest path. A component with very many nodes ends as
a star, so no task ever holds a component: its rows stay edges. The centre of a
star is looked up by ``skew.lookup``, so its rows are not one task's either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import skew
from parlance.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): every node of ``edges`` (columns a, b) with the least id of its component.

    Nodes that are their own root are included. Null ends and loops are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.save(links, f"{name}-0")
    before, step = _state(links), 0
    while True:
        step += 1
        starred = scratch.save(_large_star(links, before[0]), f"{name}-large")
        links = scratch.save(_small_star(starred, before[0]), f"{name}-{step}")
        now = _state(links)
        if now == before:
            break
        before = now
        scratch.drop(f"{name}-{step - 1}", f"{name}-large")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Two numbers that tell tables of links apart: their count and the sum of their hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame, count: int) -> DataFrame:
    """Every link (u, v) of a node to a smaller one: u is tied to the least neighbour of v, or to v where v is less."""
    most = skew.limit(links, count)
    least = links.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    heavy = links.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > most).join(least, "v", "left")
    found = skew.lookup(links.withColumn("w", F.col("v")), least, heavy, ["v"], ["m"], F.xxhash64("u"))
    return found.select("u", F.coalesce("m", "w").alias("v")).distinct()


def _small_star(links: DataFrame, count: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = least.where(F.col("n") > skew.limit(links, count))
    found = skew.lookup(links.withColumn("w", F.col("u")), least.where("n > 0"), heavy, ["u"], ["m"], F.xxhash64("v"))
    return found.select(
        F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("w").alias("u"), F.col("m").alias("v")))).alias("e")
    ).select("e.u", "e.v").where("u <> v").distinct()
