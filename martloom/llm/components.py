"""Connected components of a table of links, by alternating star steps over shuffled tables.

Nodes are compared as values, so there are no ties. Repeated links and links of a node to itself count for nothing, nor do
links with a null end; an empty table has no components. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from martloom.session import drop_scratch, scratch_path, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; a component's root is its smallest node.

    Every round writes its links to the shared folder, so a lost executor repeats a round at most.
    Neighbours of a node are never gathered: its smallest one is found with map-side combining
    and joined back, and joins of a hot node are split by adaptive execution.
    """
    spark = links.sparkSession
    now = _staged(_directed(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = _mark(now)
    while True:
        after = _staged(_small_star(_large_star(now[0])))
        seen = _mark(after)
        drop_scratch(spark, now[1])
        now = after
        if seen == mark:
            return now[0].select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _directed(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, once each."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _staged(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "links")
    return stage(df, "links", path), path


def _mark(table: tuple[DataFrame, str]) -> tuple:
    row = table[0].agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    return tuple(row)
