"""Connected components of links, as DataFrame joins.

Alternates the large-star and small-star steps: each node's larger neighbours are linked
with its smallest neighbour, then its smaller ones are. Links never grow in number, no group is
collected, and a node with very many links only makes skewed joins, which adaptive execution
splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of ids, in any order -> (node, component), the smallest id it reaches.

    Only nodes with a smaller one in reach have a row.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct()
    e = materialize(e, "links")
    while not _stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("low"))
        large = both.join(low, both["u"] == low["w"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"))
        small = large.join(low, large["u"] == low["w"]).where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = materialize(small.unionAll(low.select(F.col("w").alias("u"), F.col("low").alias("v"))).distinct(), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(e: DataFrame) -> bool:
    """Is each node linked with one smaller node, which has none itself?"""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionAll(e.select("v", F.lit(0)))
    odd = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"), F.max("up").alias("high"))
    return odd.where((F.col("ups") > 1) | (F.col("low") != F.col("high"))).isEmpty()
