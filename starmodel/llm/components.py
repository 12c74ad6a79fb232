"""Connected components of links, as Spark joins that are repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import discard, materialize


def components(links: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """`node`, `root`: the smallest node that links lead to, for every node of
    `links`. Large and small stars are formed in turn until nothing changes;
    each round is written out, so lineage stays short. A star around a hub is
    rows keyed by its leaves after the first round, and sums are combined before
    they are shuffled.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    nodes = edges
    before = None
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        made = materialize(small.where("u <> v").distinct(), "links")
        if edges is not nodes:
            discard(edges)
        edges = made
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
