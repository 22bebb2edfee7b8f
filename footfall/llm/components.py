"""Connected components of a link table, by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a large star hangs
every larger neighbour of a node on its smallest neighbour, a small star the smaller ones.
A handful of rounds suffice; each is two aggregations and two joins, so no component is
ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stash


def _hang(pairs: DataFrame) -> DataFrame:
    """(center, other) pairs -> (other, least of the center and all its others)."""
    least = pairs.groupBy("center").agg(F.min("other").alias("least"))
    return pairs.join(least, "center").select(
        "center", "other", F.least("center", "least").alias("least")
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("u").alias("center"), F.col("v").alias("other")).union(
        links.select(F.col("v").alias("center"), F.col("u").alias("other"))
    )
    return (
        _hang(both)
        .filter("other > center")
        .select(F.col("other").alias("u"), F.col("least").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(
        F.greatest("u", "v").alias("center"), F.least("u", "v").alias("other")
    )
    hung = _hang(down)
    return (
        hung.select(F.col("other").alias("u"), F.col("least").alias("v"))
        .union(hung.select(F.col("center").alias("u"), F.col("least").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def component_roots(links: DataFrame) -> DataFrame:
    """(u, v) links of integer nodes -> (node, root): the smallest node of its component.

    Nodes without a link do not occur. Loops, repeated links and links in both
    directions are allowed; links with a null end are ignored. No links give no rows.
    """
    links = stash(
        links.select("u", "v").filter("u <> v and u is not null and v is not null").distinct(),
        "links",
    )
    before = None
    while True:
        mark = links.agg(
            F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)
        ).first()
        if mark == before or not mark[0]:
            break
        before = mark
        links = stash(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
