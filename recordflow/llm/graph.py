"""Connected components by alternating star operations, for graphs that no task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.runtime import cut_lineage


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of an edge; ``component`` is the smallest node reachable.

    Large-star links every greater neighbour to the smallest neighbour, small-star every smaller one;
    rounds alternate until the edges no longer change, which takes about log(n) squared rounds at most.
    Minima are combined before the shuffle and the joins are plain equi-joins, so a hub is split by
    adaptive execution. Each round is stored in the shared folder. Edges with a null end and loops
    are left out; repeated edges count once; no edges give no rows.
    """
    now = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(
            both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = cut_lineage(small, "small-star")
        before, mark = mark, _mark(now)
        if tuple(before) == tuple(mark):
            break
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(roots)
