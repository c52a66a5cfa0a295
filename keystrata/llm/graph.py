"""Connected components of links, kept as stars, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, persist


def _stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, a root, or is a root."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    mixed = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)")
    return mixed.agg(F.count("*")).first()[0] == 0


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` for each end of ``links(u, v)``; a component's name is its least id.

    Large-star and small-star steps alternate until all links form stars, which
    takes about log(n) rounds. Each round is written to the shared folder. Links
    point from the larger id ``u`` to the smaller ``v``, so the least neighbour
    of a node, itself included, is the least ``v`` of its links.
    """
    links = persist(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _stars(links):
            break
        least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = links.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, persist(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
