"""Connected components of a link table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _all_stars(links: DataFrame) -> bool:
    """Whether every link ends at the smallest id of its component: no vertex has two links, or a link and links to it."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("back")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("back")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("back").alias("back"))
    return seen.where("out > 1 or (out = 1 and back = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id that links reach) for each id of at least one link to another id.

    Each round links every vertex's larger neighbours to its smallest one (large star), then its smaller neighbours
    and itself to the smallest (small star), until only stars are left; links stay linear in number.  Minima are
    pre-aggregated before they are shuffled, and they return to the links by a join that Spark may split, so a vertex
    with very many links is no burden to one task.  Rounds grow with the logarithm of the longest chain.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    links = written(links.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "links")
    while not _all_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    # Every vertex but the smallest of its component now has one link, to that.
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
