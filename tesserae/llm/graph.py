"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_materialized, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return r[0], r[1], r[2]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one (large star) and then its smaller neighbours
    and itself to the smallest (small star); the rows never grow beyond the edges, and rounds grow with the logarithm
    of the longest path. A node's minimum is pre-aggregated and joined back, so a hub is split like any skewed key.
    Edges with a null end and loops are left out; an empty table has no components.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low")), "stars")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("low")), "stars")
        near = large.join(low2, "u")
        small = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(near.select("u", F.col("low").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "edges")
        new = _state(after)
        drop_materialized(now, low, large, low2)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
