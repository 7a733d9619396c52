"""Generators of tiles, cells and rectangles, and interval arithmetic on windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import half_even, portable_hash, snapped


def tile_grid(spark: SparkSession, n_rows: int, n_cols: int, y_size: int, x_size: int) -> DataFrame:
    """Index windows of tiles numbered down the rows first; only the very last tile reaches the raster's edge."""
    height, width, last = y_size // n_rows, x_size // n_cols, n_rows * n_cols - 1
    r, c = F.col("id") % n_rows, F.floor(F.col("id") / n_rows)
    ends = lambda at, size, edge: F.when(F.col("id") == last, F.lit(edge)).otherwise((at + 1) * size)
    return spark.range(n_rows * n_cols).select(F.col("id").alias("tile_id"), (r * height).alias("ul_r"), ends(r, height, y_size).cast("bigint").alias("lr_r"), (c * width).alias("ul_c"), ends(c, width, x_size).cast("bigint").alias("lr_c"))


def tiles_by_aspect(n: Column, y_size: int, x_size: int) -> tuple[Column, Column]:
    """(rows, columns) of about ``n`` tiles in the raster's shape, truncated."""
    rows = F.greatest(F.sqrt(n / (x_size / y_size)).cast("int"), F.lit(1))
    return rows, (n / rows).cast("int")


def fishnet(spark: SparkSession, x_min: float, x_max: float, y_min: float, y_max: float, width: float, height: float) -> DataFrame:
    """Cells of a size that cover an extent, columns outer, rows inner from the top."""
    n_rows, n_cols = int(-((y_min - y_max) // height)), int(-((x_min - x_max) // width))
    c, r = F.floor(F.col("id") / n_rows), F.col("id") % n_rows
    return spark.range(n_rows * n_cols).select(F.col("id").alias("cell_id"), (F.lit(x_min) + c * width).alias("x_min"), (F.lit(y_max) - r * height).alias("y_max"), (F.lit(x_min) + (c + 1) * width).alias("x_max"), (F.lit(y_max) - (r + 1) * height).alias("y_min"))


def support_rectangles(cells: DataFrame, n: int, x_size: int, y_size: int, resolution: int, seed: int) -> DataFrame:
    """``n`` rectangles for each cell around centres drawn in it by a hash, snapped to the raster."""
    drawn = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    key = F.col("cell_id") * n + F.col("k")
    inside = lambda low, high, s: F.col(low) + F.floor((F.col(high) - F.col(low)) * portable_hash(key, s) / 4294967296)
    centred = drawn.select(key.alias("set_id"), snapped(inside("x_min", "x_max", seed), 0, resolution).cast("bigint").alias("ctr_x"), snapped(inside("y_min", "y_max", seed + 1), 0, resolution).cast("bigint").alias("ctr_y"))
    return centred.select("set_id", (F.col("ctr_x") - x_size // 2).alias("ul_x"), (F.col("ctr_y") + y_size // 2).alias("ul_y"), (F.col("ctr_x") + x_size // 2).alias("lr_x"), (F.col("ctr_y") - y_size // 2).alias("lr_y"), "ctr_x", "ctr_y")


def interval_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> tuple[Column, Column]:
    """Start and end of what two half-open intervals share, null if nothing."""
    start, end = F.greatest(start_a, start_b), F.least(end_a, end_b)
    return F.when(start < end, start), F.when(start < end, end)


def with_halo(tiles: DataFrame, by: int, y_size: int, x_size: int) -> DataFrame:
    """Tile windows grown by a buffer and clipped to the raster."""
    return tiles.select("tile_id", F.greatest(F.col("ul_r") - by, F.lit(0)).alias("ul_r"), F.least(F.col("lr_r") + by, F.lit(y_size)).alias("lr_r"), F.greatest(F.col("ul_c") - by, F.lit(0)).alias("ul_c"), F.least(F.col("lr_c") + by, F.lit(x_size)).alias("lr_c"))


def common_extent(extents: DataFrame) -> DataFrame:
    """What all rectangles (ul_x, ul_y, lr_x, lr_y) share."""
    return extents.agg(F.max("ul_x").alias("ul_x"), F.min("ul_y").alias("ul_y"), F.min("lr_x").alias("lr_x"), F.max("lr_y").alias("lr_y"))


#: Statistics of a coarser cell by name.
RESAMPLERS = {
    "average": F.avg,
    "mode": lambda v: F.mode(v, True),
    "min": F.min,
    "max": F.max,
    "med": F.median,
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
}


def resample(raster: DataFrame, factor: int, how: str) -> DataFrame:
    """(row, col, value) of cells ``factor`` times as wide; nulls don't count."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return raster.groupBy(*cell).agg(RESAMPLERS[how](F.col("value")).alias("value"))


def window(raster: DataFrame, ul_r: int, lr_r: int, ul_c: int, lr_c: int, fill: float | None = None) -> DataFrame:
    """A dense window of a raster; pixels outside the raster or null take ``fill``."""
    spark = raster.sparkSession
    width = lr_c - ul_c
    grid = spark.range((lr_r - ul_r) * width).select((F.floor(F.col("id") / width) + ul_r).cast("int").alias("row"), (F.col("id") % width + ul_c).cast("int").alias("col"))
    inside = raster.where(F.col("row").between(ul_r, lr_r - 1) & F.col("col").between(ul_c, lr_c - 1)).select("row", "col", "value")
    return grid.join(inside, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def narrowest(df: DataFrame, column: str) -> DataFrame:
    """Whole numbers of a column in the narrowest integer type that holds them all."""
    low, high = df.agg(F.min(column), F.max(column)).first()  # one row
    for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
        if low is None or -(2**bits) <= low and high < 2**bits:
            return df.withColumn(column, half_even(F.col(column)).cast(kind) if kind != "bigint" else F.bround(column, 0).cast(kind))
    raise ValueError(f"{column} holds numbers beyond 64 bits")


def seeded_cells(spark: SparkSession, cell: tuple[int, int], extent: tuple[int, int, int, int], seed: tuple[int, int], x_sign: int = 1, y_sign: int = -1) -> DataFrame:
    """Cells (height, width) around a seed point that cover an extent (min_x, min_y, max_x, max_y): (ul_x, ul_y, lr_x, lr_y)."""
    height, width = cell
    min_x, min_y, max_x, max_y = extent
    x, y = seed
    less_x, more_x = int((x - min_x) / width + 1), int((max_x - x) / width)
    less_y, more_y = int((y - min_y) / height), int((max_y - y) / height + 1)
    n_x, n_y = less_x + more_x + 1, less_y + more_y + 1
    i, j = F.floor(F.col("id") / n_y) - less_x, F.col("id") % n_y - less_y
    at = spark.range(n_x * n_y).select(F.col("id").alias("cell_id"), (F.lit(x) + i * width).alias("ul_x"), (F.lit(y) + j * height).alias("ul_y"))
    return at.select("*", (F.col("ul_x") + width * x_sign).alias("lr_x"), (F.col("ul_y") + height * y_sign).alias("lr_y"))


def transforms(rects: DataFrame, x_res: int, y_res: int, snap: tuple[int, int] | None = None) -> DataFrame:
    """The affine that each feature would be rasterised by (its corner snapped to a grid), and its size in pixels."""
    ul_x = F.col("ul_x") if x_res > 0 else F.col("lr_x")
    ul_y = F.col("lr_y") if y_res > 0 else F.col("ul_y")
    if snap:
        ul_x, ul_y = snapped(ul_x, snap[0], x_res), snapped(ul_y, snap[1], y_res)
    n = lambda a, b, res: F.ceil((F.col(b) - F.col(a)) / abs(res))
    return rects.select("set_id", ul_x.alias("tx_x"), F.lit(x_res).alias("x_res"), ul_y.alias("tx_y"), F.lit(y_res).alias("y_res"), n("lr_y", "ul_y", y_res).alias("n_rows"), n("ul_x", "lr_x", x_res).alias("n_cols"))


def zone_windows(zones: DataFrame, y_size: Column, x_size: Column, affine) -> DataFrame:
    """For zones (set_id and corners) that meet a raster: their pixel window in it, and the part of the zone's own window that this is."""
    row, col = ((F.col("ul_y") - affine[3]) / affine[5]).cast("int"), ((F.col("ul_x") - affine[0]) / affine[1]).cast("int")
    height, width = (F.abs((F.col("ul_y") - F.col("lr_y")) / affine[5])).cast("int"), (F.abs((F.col("lr_x") - F.col("ul_x")) / affine[1])).cast("int")
    out = [F.col("set_id")]
    keep = F.lit(True)
    for name, at, n, size in (("row", row, height, y_size), ("col", col, width, x_size)):
        start, end = F.greatest(at, F.lit(0)), F.least(at + n, size)
        keep &= start < end
        out += [start.cast("int").alias(f"{name}_from"), end.cast("int").alias(f"{name}_to"), (start - at).cast("int").alias(f"zone_{name}_from"), (end - at).cast("int").alias(f"zone_{name}_to")]
    return zones.where(keep).select(*out)


def aligned(raster: DataFrame, like: DataFrame, down: int, right: int, fill: float, masked: Column | None = None) -> DataFrame:
    """A raster moved by whole pixels onto the grid of another; ``fill`` where it has no data or ``masked`` (of the other's ``value``) holds."""
    moved = raster.select((F.col("row") + down).cast("int").alias("row"), (F.col("col") + right).cast("int").alias("col"), F.col("value").alias("moved"))
    joined = like.select("row", "col", "value").join(moved, ["row", "col"], "left")
    kept = F.col("moved") if masked is None else F.when(~F.coalesce(masked, F.lit(False)), F.col("moved"))
    return joined.select("row", "col", F.coalesce(kept, F.lit(fill)).alias("value"))


def blocks(raster: DataFrame, side: int) -> DataFrame:
    """Count, least and greatest value of each square block of a raster."""
    at = [F.floor(F.col(c) / side).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    return raster.groupBy(*at).agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def masked_outside(raster: DataFrame, inside: Column, fill) -> DataFrame:
    """A raster with ``fill`` outside a region."""
    return raster.withColumn("value", F.when(inside, F.col("value")).otherwise(F.lit(fill)))


#: Weights of cubic convolution half a pixel off, the outer ones negative.
CUBIC = (-0.0625, 0.5625, 0.5625, -0.0625)


def halved_cubic(raster: DataFrame) -> DataFrame:
    """A raster of half as many rows and columns by cubic convolution over four by four pixels; cells without all sixteen are left out."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(CUBIC[i + 1] * CUBIC[j + 1]).alias("w")) for i in range(-1, 3) for j in range(-1, 3)])
    placed = raster.where(F.col("value").isNotNull()).select("row", "col", "value", F.explode(each).alias("o"))
    at = placed.select((F.col("row") - F.col("o.i")).alias("r"), (F.col("col") - F.col("o.j")).alias("c"), (F.col("value") * F.col("o.w")).alias("part"))
    cells = at.where("r % 2 = 0 AND c % 2 = 0").groupBy(F.floor(F.col("r") / 2).cast("int").alias("row"), F.floor(F.col("c") / 2).cast("int").alias("col")).agg(F.sum("part").alias("value"), F.count("*").alias("n"))
    return cells.where("n = 16").drop("n")


def _cubic(d: Column) -> Column:
    """The weight of cubic convolution at a distance of up to two pixels."""
    t = F.abs(d)
    return F.when(t <= 1, (1.5 * t - 2.5) * t * t + 1).otherwise(((-0.5 * t + 2.5) * t - 4) * t + 2)


#: For each way to resample: pixels that a target takes along an axis, how far the first lies before its position, and their weights.
KERNELS = {
    "nearest": (1, 0.5, lambda d: F.lit(1.0)),
    "bilinear": (2, 1.0, lambda d: 1 - F.abs(d)),
    "cubic": (4, 2.0, _cubic),
}


def _along(raster: DataFrame, axis: str, keep: str, origin: tuple[float, float], step: tuple[float, float], n: int, how: str) -> DataFrame:
    """One axis of a raster on other lines: every line is sent to the targets whose kernel holds it, which a division finds, with its weight; a target is whole if it has all lines of its kernel."""
    taps, reach, weight = KERNELS[how]
    ratio = step[1] / step[0]
    start = (origin[1] + step[1] / 2 - origin[0]) / step[0] - 0.5  # where the first target's centre lies, in lines of the source
    position = lambda k: start + k * ratio
    near = [F.floor((F.col(axis) - start + side * (reach + 1)) / ratio) for side in (-1, 1)]
    first, last = F.greatest(F.least(*near), F.lit(0)), F.least(F.greatest(*near) + 1, F.lit(n - 1))
    sent = raster.withColumns({"_a": first.cast("bigint"), "_b": last.cast("bigint")}).where("_a <= _b").withColumn("_to", F.explode(F.sequence("_a", "_b")))
    # the kernel begins at the first line at or after its reach, so there are always as many lines as taps
    begin = F.floor(position(F.col("_to")) - reach) + 1
    away = F.col(axis) - position(F.col("_to"))
    held = sent.where((F.col(axis) >= begin) & (F.col(axis) < begin + taps))
    out = held.groupBy(F.col("_to").cast("int").alias(axis), keep).agg(F.sum(F.col("value") * weight(away)).alias("value"), F.count("value").alias("_n"))
    return out.where(F.col("_n") == taps).drop("_n")


def resampled(raster: DataFrame, source: Sequence[float], target: Sequence[float], n_rows: int, n_cols: int, how: str = "cubic") -> DataFrame:
    """(row, col, value) of a raster (row, col, value) on the pixels of another affine, by any factor and offset.

    ``source`` and ``target``: (ul_x, x_res, 0, ul_y, 0, y_res). Kernels are separable, so rows are resampled first and
    then columns, each by one aggregation that is combined before it is shuffled; the weights follow from where each
    target centre lies in the source. Targets whose kernel leaves the source or meets a null are left out. ``how``:
    nearest (the greater of equally near pixels), bilinear or cubic.
    """
    held = raster.where(F.col("value").isNotNull()).select("row", "col", F.col("value").cast("double").alias("value"))
    down = _along(held, "row", "col", (source[3], target[3]), (source[5], target[5]), n_rows, how)
    return _along(down, "col", "row", (source[0], target[0]), (source[1], target[1]), n_cols, how).select("row", "col", "value")


def shift_between(source: Sequence[float], like: Sequence[float]) -> tuple[int, int]:
    """(down, right): the whole pixels that lie between the corners of two rasters of one resolution, as ``aligned`` moves them; the nearest, where they are off by parts of a pixel."""
    if abs(source[1] - like[1]) > 1e-9 or abs(source[5] - like[5]) > 1e-9:
        raise ValueError("rasters of unlike resolution are resampled, not moved")
    return round((source[3] - like[3]) / like[5]), round((source[0] - like[0]) / like[1])
