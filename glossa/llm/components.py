"""Connected components of a table of links, by alternating stars.

Each round replaces links by links to smaller neighbours (large star: a vertex's larger
neighbours are linked to its smallest one; small star: its smaller ones and itself are)
and writes the result to the shared folder.  The number of rounds grows with the
logarithm of a component's width.  Only counts and checksums reach the driver.  A hub,
a vertex with more than one in MOST_HOT of all links, meets its links where they are.

Defined cases: links of a vertex with itself, repeated links and links in both directions
count once or not at all; without links there are no vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import written
from glossa.llm.skew import MOST_HOT

#: Links that one plain join holds with ease, hubs or not.
SMALL = 100_000


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """links: n of them, u > v.  Large: both directions count as neighbours; small: the smaller ones."""
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
    if n <= SMALL:
        joined = near.join(least, "u")
    else:  # fewer than 2 * MOST_HOT hubs
        hubs, others = F.broadcast(least.where(F.col("d") * MOST_HOT > n)), least.where(F.col("d") * MOST_HOT <= n)
        joined = near.join(hubs, "u").unionByName(near.join(hubs.select("u"), "u", "left_anti").join(others, "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b (long).  Returns vertex and label, the least vertex of its component, for all vertices."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        larger = _star(edges, True, state[0])
        edges = written(_star(written(larger, "stars") if state[0] > SMALL else larger, False, state[0]), "stars")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
