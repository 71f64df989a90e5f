"""Connected components by alternating large-star and small-star rounds on edge tables.

Nothing is collected: each round is a grouped minimum, combined before the shuffle, and a
join that Spark may split where a centre is hot; its result is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges u > v. Large: neighbours above u go to u's least; small: those below, and u."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the least node of its component) for every node of an edge but the labels."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state, now = found, stored(_star(_star(now, small=False), small=True), "edges")
