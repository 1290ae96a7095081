"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregations and joins on node ids, so no task or driver
holds the links of more than its own partition; the number of rounds grows with
the logarithm of the components' size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node reachable.  Longs; loops and repeats are allowed."""
    edges = checkpoint(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        # large star: every larger neighbour of a node moves to the smallest one in the node's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, move to the smallest
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def lookup(rows: DataFrame, key: str | list[str], table: DataFrame, parts: int = 16) -> DataFrame:
    """``rows`` left joined with ``table`` (a row for each ``key``), a frequent key spread over ``parts`` tasks.

    The distinct (key, part) pairs, few for any key, fetch the value; rows then
    meet it by key and part.  Null keys meet nothing and stay.
    """
    by = [key] if isinstance(key, str) else key
    split = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    found = split.where(" and ".join(f"{k} is not null" for k in by)).select(*by, "part").distinct().join(table, by)
    return split.join(found, [*by, "part"], "left").drop("part")
