"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import use_shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of an undirected edge list; root is the least node of its component.

    Each round links every node to the least one it knows, first over its larger neighbours, then over its smaller
    ones; the number of edges never grows. A hub's neighbours are only joined and minimised, never gathered in a list.
    Rounds end when the links no longer change. The state of each round is checkpointed, so lineage stays short and a
    lost executor costs one round. No edges: no rows. Self-loops and nulls are ignored, repeated edges count once.
    """
    use_shared_dir(edges.sparkSession)
    cur = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct().checkpoint()
    last = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low2, "v").select("m", "u", "v")
        cur = (
            small.select(F.col("m").alias("u"), "v")
            .union(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
            .where("u < v")
            .distinct()
            .checkpoint()
        )
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return cur.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        cur.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
