"""Height pyramids over a stream of points; an extension beyond batch use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


def windowed_heights(points: DataFrame, grid: Grid, zoom: int, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Least and greatest height (z) and count of each tile of a zoom in tumbling windows; rows later than `late` are dropped.

    The state is one row for each window and tile with data."""
    x, y = grid.crs_to_tile(F.col("x"), F.col("y"), F.lit(zoom))
    p = points.withWatermark(ts, late).select(F.window(ts, window).alias("w"), x.alias("tx"), y.alias("ty"), "z").where("tx is not null")
    return p.groupBy("w", "tx", "ty").agg(F.min("z").alias("min_h"), F.max("z").alias("max_h"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.lit(zoom).alias("zoom"), F.col("tx").alias("x"), F.col("ty").alias("y"), "min_h", "max_h", "n")


def rollup(tiles: DataFrame, zoom: int) -> DataFrame:
    """Heights of all ancestors of finished windows' tiles."""
    up = tiles.select("start", "x", "y", "min_h", "max_h", "n", F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("k"))
    key = ["start", (F.lit(zoom) - F.col("k")).alias("zoom"), F.expr("shiftright(x, k)").alias("x"), F.expr("shiftright(y, k)").alias("y")]
    return up.groupBy(*key).agg(F.min("min_h").alias("min_h"), F.max("max_h").alias("max_h"), F.sum("n").alias("n"))


def start(points: DataFrame, grid: Grid, zoom: int, checkpoint: str, write: Callable[[DataFrame, int], None], **options):
    """Starts the stream: finished windows go, with their ancestors, to `write(rows, batch)`.

    Batches are numbered, so a writer that overwrites by number gives each window once."""
    t = windowed_heights(points, grid, zoom, **options)
    return t.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(rollup(df, zoom), n)).start()
