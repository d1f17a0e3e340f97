"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join on the node, so no neighbourhood is ever held
in one task: grouped minima combine on the map side and AQE splits a skewed join. The edge table
shrinks towards one star for each component; rounds grow with the logarithm of the longest path.
Each round is written to the shared checkpoint folder, so a lost executor costs one round only, and has as many partitions as its edges need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import compacted


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("h"), F.col("u").alias("k"), F.least("u", "m").alias("m"))
    # on a hash of the node: both sides are dealt out anew, and AQE can split a star's hot centre
    return both.where("v > u").join(least, (F.xxhash64("u") == F.col("h")) & (F.col("u") == F.col("k"))).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
    crossed = e.join(least, F.col("hi") == F.col("k")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return crossed.union(least.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct()


def _on_driver(e: DataFrame) -> DataFrame:
    """Union-find over a few edges."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in e.collect():
        x, y = root(r["hi"]), root(r["lo"])
        up[max(x, y)] = min(x, y)
    kind = e.schema["hi"].dataType.simpleString()
    return e.sparkSession.createDataFrame([(x, root(x)) for x in list(up)], f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node; component is the smallest node.

    Self-loops and rows with a null end say nothing about other nodes and are ignored, repeated
    edges count once, an edge may come in either direction. Nodes without edges are not returned: the caller
    knows them and labels them with themselves. Raises if ``max_rounds`` do not suffice. Up to ``small`` different edges,
    counted first, are joined on the driver, which saves the rounds on small stories; by default none are.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    e = compacted(e)
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    if before[0] <= small:
        return _on_driver(e)
    for _ in range(max_rounds):
        e = compacted(_small_star(_large_star(e)))
        after = _state(e)
        if after == before:
            roots = e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
