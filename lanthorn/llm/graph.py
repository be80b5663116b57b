"""Connected components of a table of links, without gathering links on the driver.

Large-star and small-star rounds (Kiveris and others, "Connected Components in MapReduce and Beyond", 2014): each
round is a minimum by key with map-side combining and a join, and its result is a written table, so that lineage
stays short and a lost executor costs one round at most. The rounds end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.llm.scratch import Scratch, fixed_point


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) of one type -> (node, component): the smallest node reachable, for every node that has a link to another.

    Nulls and links from a node to itself are ignored; links may repeat and have any direction. An empty table gives none.
    """
    kind = links.schema["src"].dataType
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = scratch.save(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    seen = [tuple(mark(edges))]

    def step(now: DataFrame) -> tuple[DataFrame, bool]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        scratch.drop(now)
        seen.append(tuple(mark(after)))
        return after, seen[-1] == seen[-2]

    last = edges if seen[0][0] == 0 else fixed_point(step, edges)
    nodes = last.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = last.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
