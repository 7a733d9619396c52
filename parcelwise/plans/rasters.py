"""Queries that write rasters by tile and read them by window."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import rasters
from ..sources import tables as src
from .common import rounded

sql = src.sql
#: Pixels along a tile's side.
SIDE = 20
#: Tiles of ten by ten pixels in a folder.
TILES = 1000


def place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def window_reads(spark, d):
    """Statistics of the window of each support rectangle, read from a tiled raster."""
    path = place(spark, "tiled")
    rasters.write_tiled(src.pixels(spark, d).select("id", "row", "col", "value"), path, SIDE)
    at = lambda c, sign: (sign * F.col(c) / 30).cast("int")
    windows = src.rectangles(spark, d).select("set_id", at("ul_y", -1).alias("row_from"), at("lr_y", -1).alias("row_to"), at("ul_x", 1).alias("col_from"), at("lr_x", 1).alias("col_to"))
    held = rasters.read_windows(spark, path, windows, SIDE)
    return rounded(held.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.avg("value").alias("mean")), 4)


def padded_window(spark, d):
    """A window that reaches beyond the raster's upper right corner, read from its tiles."""
    path = place(spark, "tiled")
    rasters.write_tiled(src.pixels(spark, d).select("row", "col", "value"), path, SIDE)
    return rasters.read_padded(spark, path, (-4, 33), (71, 108), -9999.0, SIDE)


def resumed_tiles(spark, d):
    """A raster's tiles written in two runs, of which the second takes up what the first had left; what is then there."""
    path = place(spark, "resumed")
    pixels = src.pixels(spark, d).select("tile_id", "id", "row", "col", F.col("value").alias("value"))
    wanted = pixels.select("tile_id").distinct()
    rasters.write_resumably(pixels, wanted.where("tile_id % 3 <> 0"), path, TILES)
    rasters.write_resumably(pixels, wanted, path, TILES)
    there = spark.read.parquet(path)
    return rounded(there.groupBy(F.col("tile_id").cast("int").alias("tile_id")).agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.avg("value").alias("mean")), 4)


def mosaic_layers(spark, d):
    """Tiles that overlap by half, the later one first: halves of tiles of twenty by twenty pixels, some without data, as whole numbers of 16 bits."""
    p = src.pixels(spark, d).select("row", "col", (F.col("value") / 10).cast("int").alias("value"))
    shifted = F.explode(F.array(F.lit(0), F.lit(1)))
    layers = p.withColumn("k", shifted).select("row", "col", (F.floor((F.col("row") + 10 * F.col("k")) / 20) * 100 + F.floor((F.col("col") + 10 * F.col("k")) / 20) * 2 + F.col("k")).alias("layer"), (F.col("value") + F.col("k")).alias("value"), "k")
    return rasters.mosaic(layers.where("NOT (layer % 3 = 0 AND k = 1)"), "layer", "smallint", nodata=7)


ALL = {
    "window_reads": (window_reads, sql("px", "rect", body="""SELECT set_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id, round(avg(value), 4) AS mean
      FROM rect JOIN px ON "row" >= -ul_y // 30 AND "row" < -lr_y // 30 AND col >= ul_x // 30 AND col < lr_x // 30 GROUP BY set_id""")),
    "padded_window": (padded_window, sql("px", body="""SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, coalesce(p.value, -9999.0) AS value
      FROM range(-4, 33) a(r) CROSS JOIN range(71, 108) b(c) LEFT JOIN px p ON p."row" = r AND p.col = c""")),
    "resumed_tiles": (resumed_tiles, sql("px", body="SELECT tile_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id, round(avg(value), 4) AS mean FROM px GROUP BY tile_id")),
    "mosaic_layers": (mosaic_layers, sql("px", body=""", l AS (SELECT "row", col, CAST(trunc(value / 10) AS INTEGER) + k AS value, k, (("row" + 10 * k) // 20) * 100 + ((col + 10 * k) // 20) * 2 + k AS layer FROM px, range(2) r(k)),
      h AS (SELECT * FROM l WHERE NOT (layer % 3 = 0 AND k = 1) AND value BETWEEN -32768 AND 32767 AND value <> 7)
      SELECT "row", col, CAST(arg_max(value, layer) AS SMALLINT) AS value FROM h GROUP BY "row", col""")),
}
