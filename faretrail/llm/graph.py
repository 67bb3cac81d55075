"""Distributed connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named
    by its smallest node.

    Alternating large-star and small-star steps: each step only takes a
    minimum per node (combined before the shuffle) and a join, so no
    neighbourhood is gathered and a hub's rows can be split as join skew. The
    edges of every step are written out, so lineage stays short. Self loops
    and rows with a null end are ignored; an empty input gives an empty result.
    """
    cur = scratch.keep(
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    stamp = _stamp(cur)
    while stamp[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = scratch.keep(small)
        now = _stamp(nxt)
        scratch.drop(cur)
        cur, done, stamp = nxt, now == stamp, now
        if done:
            break
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select("component", "component").distinct())
