"""Connected components of links between documents, by alternating star rounds.

Every round is a few joins and aggregates, its links are written to the shared folder,
and rounds grow with the logarithm of the longest path.  Nothing is gathered on the
driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every larger (large) or not larger (small) neighbour of a node to the least node around it."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = down.union(down.select("v", "u")) if large else down
    # Written out, so that the join deals both sides anew and Spark can split a node with very many neighbours.
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    found = around.join(least.hint("shuffle_hash"), "u")
    moved = found.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = found.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, component (the least node that a node is linked with, over any path) from links a, b (long)."""
    current = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        current = stored(_star(stored(_star(current, large=True), name), large=False), name)
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
