"""Connected components of a link table, with joins and minima only.

Each round lets every node hand its smallest neighbour to its larger neighbours, then to its smaller ones
(the large-star and small-star steps known from the literature), until the links form stars. The number of
rounds grows with the logarithm of the longest path. Minima are combined before they are shuffled and written
before they are joined, so that a node with very many links is split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirefold.session import stage


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str, name: str = "component") -> DataFrame:
    """(node, `name`) for every node of the links; the component is its smallest node.

    Self-links and repeated links are allowed, links with a null end are dropped, no links give no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stage(links.select(u, v).distinct(), "links")
    seen = None
    while (now := _fingerprint(links)) != seen and now[0]:
        seen = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = stage(large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return links.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias(name))
