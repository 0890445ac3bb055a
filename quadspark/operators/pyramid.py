"""Height pyramids over a quadtree of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def height_pyramid(leaves: DataFrame, zoom: int, x: str = "x", y: str = "y", h: str = "h") -> DataFrame:
    """Minimum and maximum height of every tile from the leaf zoom up to zoom 0.

    Leaves are reduced first; only one row a leaf tile is fanned out to its ancestors, so the fan-out never multiplies the
    points.  A tile without data is absent.
    """
    leaf = leaves.groupBy(F.col(x).cast("long").alias("lx"), F.col(y).cast("long").alias("ly")).agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(F.lit(1)).alias("c"))
    up = leaf.select("*", F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("k"))
    key = [(F.lit(zoom) - F.col("k")).cast("int").alias("zoom"), F.expr("shiftright(lx, k)").alias("x"), F.expr("shiftright(ly, k)").alias("y")]
    return up.groupBy(*key).agg(F.min("lo").alias("min_h"), F.max("hi").alias("max_h"), F.sum("c").alias("n"))
