"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import written

#: Pointer jumps in a round: a chain shrinks by 2 to this power. Most links are
#: stars, which one round contracts without any.
JUMPS = 1


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of links (a, b), the component
    being its smallest node; nodes without links don't appear. No links give
    no rows; repeated links and loops change nothing; null ends are ignored.

    Each round, every node points to its smallest neighbour (a minimum, so
    combined before the shuffle), pointers are followed a few steps, and links
    are rewritten to what their ends point to. Links inside a component vanish
    as it contracts. Rounds are written to the shared folder.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = edges.where("a is not null and b is not null").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = written(links.distinct(), "links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        for _ in range(JUMPS):
            step = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            point = point.join(step, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        point = written(point, "pointers")
        levels.append(point)
        ends = links.where("a <> b").join(point, "a").select(F.col("p").alias("x"), "b")
        ends = ends.join(point.withColumnRenamed("a", "b"), "b").select("x", F.col("p").alias("y")).where("x <> y")
        links = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[0].toDF("node", "component")
    for level in levels[1:]:
        out = out.join(level.toDF("component", "next"), "component", "left").select(
            "node", F.coalesce("next", "component").alias("component")
        )
    return out
