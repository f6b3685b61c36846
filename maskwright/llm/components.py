"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). Returns node, component (the smallest node reachable) of every node with an edge, as a table of written().

    Each round moves every edge towards smaller nodes and is written to the shared
    folder, where the last one's table is deleted; the number of rounds grows with the
    logarithm of the longest path. The driver sees one count and one checksum a round. Loops and repeated edges are
    harmless; edges with a null end are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    stars = common.written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        around = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, stars = stars, common.written(small.where("u <> v").distinct(), "stars")
        common.dropped(last, sweep=False)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = stars.select(F.col("v").alias("node")).distinct()
    found = common.written(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component"))), "components")
    common.dropped(stars, sweep=False)
    return found
