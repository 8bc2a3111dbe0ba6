"""Connected components of a link table, by large-star and small-star rounds in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.storage import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over rows (u, v), u > v: each node links its neighbours to the least of them.

    large-star looks at both directions and moves the larger neighbours; small-star moves the
    smaller ones. The least neighbour is a partial aggregate and joins back on the node, so a
    node with very many links is split by the adaptive skew join.
    """
    seen = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    moved = seen.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b); component is its least node.

    Any comparable node type. Each round writes its table to the shared folder; a count and a
    checksum tell when nothing changes any more (a logarithmic number of rounds).
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    mark = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = materialize(_star(_star(now, small=False), small=True), name)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
