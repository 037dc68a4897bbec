"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, kept, spread_join, written

FEW = 200_000  # links that one task holds with ease: so few are handled without shuffles


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that links reach, for every node of ``links`` (a, b).

    Alternates large stars and small stars: each round points nodes to the least one
    around them, so paths shorten by halves. Every round aggregates before it shuffles
    and ends in a checkpoint; it stops when no link changes, and raises if any still does after
    ``rounds``, which links of any size and shape are far from. What a frequent node has is
    joined where its links are. Up to FEW links, counted first, are one partition, in which
    aggregates and joins need no shuffle."""
    star = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    number = star.count()
    few = number <= FEW
    near = lambda df: df.coalesce(1) if few else df
    often = F.col("times") * HOT >= number
    with_least = lambda df, least: (df.join(least, "u") if few else spread_join(df, written(least), "u", often, F.xxhash64("v"))).drop("times")
    star, seen = near(star), None
    for _ in range(rounds):
        both = near(star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("times"))
        large = with_least(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if few else kept(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = with_least(large, down)
        star = near(kept(near(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))).distinct()))
        state = star.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"The components of {number} links aren't found after {rounds} rounds.")
    return star.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
