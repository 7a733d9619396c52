"""Rasters as tables of tiles: windows that read the files they need only, and writes that can be taken up again.

A tiled raster is Parquet partitioned by ``tile_row`` and ``tile_col``, squares of ``SIDE`` pixels, with the rows of
each file in order, so a window becomes filters on partitions and, within a file, on row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Pixels along a side of a tile.
SIDE = 512


def tile_of(axis: str, side: int) -> Column:
    return F.floor(F.col(axis) / side).cast("int")


def write_tiled(pixels: DataFrame, path: str, side: int = SIDE) -> None:
    """Pixels (row, col, ...) as a tiled raster, each tile in one file."""
    tiled = pixels.withColumns({"tile_row": tile_of("row", side), "tile_col": tile_of("col", side)})
    tiled.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.partitionBy("tile_row", "tile_col").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int = SIDE) -> DataFrame:
    """The pixels of a window [from, to) of a tiled raster: only the folders of its tiles are listed into the scan."""
    (r0, r1), (c0, c1) = rows, cols
    tiles = F.col("tile_row").between(r0 // side, (r1 - 1) // side) & F.col("tile_col").between(c0 // side, (c1 - 1) // side)
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return spark.read.parquet(path).where(tiles & inside).drop("tile_row", "tile_col")


def read_padded(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], nodata, side: int = SIDE) -> DataFrame:
    """(row, col, value) of every pixel of a window, ``nodata`` where the raster has none; the window may lie outside of it in part or whole."""
    held = read_window(spark, path, rows, cols, side).select("row", "col", "value")
    n_rows, n_cols = max(rows[1] - rows[0], 0), max(cols[1] - cols[0], 0)
    every = spark.range(n_rows * n_cols).select((F.floor(F.col("id") / max(n_cols, 1)) + rows[0]).cast("int").alias("row"), (F.col("id") % max(n_cols, 1) + cols[0]).cast("int").alias("col"))
    return every.join(held, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(nodata)).alias("value"))


def read_windows(spark: SparkSession, path: str, windows: DataFrame, side: int = SIDE) -> DataFrame:
    """The pixels of each of a table of windows (row_from, row_to, col_from, col_to and what else they have), beside the window's columns.

    Windows meet tiles on the partition columns; where they are few enough to be broadcast, the scan is pruned to the
    tiles that they touch while it runs. Empty windows have no pixels.
    """
    span = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{axis}_from") / side).cast("int"), F.floor((F.col(f"{axis}_to") - 1) / side).cast("int")))
    asked = windows.where("row_from < row_to AND col_from < col_to").withColumn("tile_row", span("row")).withColumn("tile_col", span("col"))
    pixels = spark.read.parquet(path)
    held = pixels.join(asked, ["tile_row", "tile_col"]).where("row >= row_from AND row < row_to AND col >= col_from AND col < col_to")
    return held.drop("tile_row", "tile_col")


def _sum_of(columns: list[str]) -> Column:
    """A sum over rows that tells tiles apart whatever their order, without overflow."""
    return F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 31)))


def written_tiles(spark: SparkSession, path: str) -> DataFrame | None:
    """(tile_id, n, mark) of what is there of an output; None if nothing is."""
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        return None
    return there.groupBy("tile_id").agg(F.count("*").alias("n"), _sum_of(sorted(set(there.columns) - {"tile_id", "tile_block"})).alias("mark"))


def unfinished(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """The ``wanted`` tiles (tile_id) whose output isn't there whole: not in the manifest, or not with the rows that the manifest says.

    An output that lost files, or was written without reaching its manifest, counts as not written.
    """
    there = written_tiles(spark, path)
    try:
        manifest = spark.read.schema("tile_id int, n long, mark long, written_at timestamp").json(f"{path}.manifest")
        manifest.limit(1).collect()
    except Exception as e:  # the manifest is written with the first tiles
        if "PATH_NOT_FOUND" not in str(e):
            raise
        manifest = None
    if there is None or manifest is None:
        return wanted.select("tile_id").distinct()
    last = manifest.groupBy("tile_id").agg(F.max_by(F.struct("n", "mark"), "written_at").alias("said"))
    whole = there.join(last, "tile_id").where((F.col("n") == F.col("said.n")) & (F.col("mark") == F.col("said.mark")))
    # a tile without pixels has a line in the manifest alone
    empty = last.where("said.n = 0").join(there, "tile_id", "left_anti")
    return wanted.select("tile_id").distinct().join(whole.select("tile_id").unionByName(empty.select("tile_id")), "tile_id", "left_anti")


def write_resumably(pixels: DataFrame, wanted: DataFrame, path: str, per_folder: int = 1) -> int:
    """Write the tiles of ``wanted`` (tile_id) that aren't there whole yet, and their lines of the manifest; how many those were.

    ``pixels`` (tile_id, ...) is computed for these tiles only. Each replaces what its own folder held, so a run that
    was cut short is taken up by the next, and a second run changes nothing. The manifest is appended to after the tiles
    are in place: what it names was there.

    ``per_folder``: for small tiles, so many neighbouring ones share a folder ``tile_block`` and a file of it, sorted by
    tile; the number of files then follows from the pixels. Folders with tiles to do are replaced, with the other tiles
    that they held. An output keeps the ``per_folder`` that it was begun with.
    """
    from ..session import cut

    spark = pixels.sparkSession
    todo = cut(unfinished(spark, wanted, path).withColumn("tile_id", F.col("tile_id").cast("int")))
    n = todo.count()
    if not n:
        return 0
    rows = pixels.withColumn("tile_id", F.col("tile_id").cast("int")).join(todo, "tile_id", "left_semi")
    folder = "tile_id"
    if per_folder > 1:
        folder, block = "tile_block", F.floor(F.col("tile_id") / per_folder).cast("int")
        rows = rows.withColumn("tile_block", block)
        if written_tiles(spark, path) is not None:
            there = spark.read.parquet(path)
            others = there.join(todo.select(block.alias("tile_block")).distinct(), "tile_block", "left_semi").join(todo, "tile_id", "left_anti")
            rows = rows.unionByName(cut(others))
    placed = rows.repartition(folder).sortWithinPartitions(*dict.fromkeys([folder, "tile_id"]))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)
    made = written_tiles(spark, path)
    lines = todo if made is None else todo.join(made, "tile_id", "left")
    lines = lines.withColumns({"n": F.lit(0).cast("bigint"), "mark": F.lit(0).cast("bigint")}) if made is None else lines.fillna(0, ["n", "mark"])
    lines.withColumn("written_at", F.current_timestamp()).write.mode("append").json(f"{path}.manifest")
    return n


def mosaic(layers: DataFrame, order: str, kind: str = "smallint", nodata: float | None = None) -> DataFrame:
    """(row, col, value) of overlapping tiles as one raster of one type: at each pixel the layer that comes last in ``order`` and has data there.

    Values that ``kind`` can't hold, nulls and ``nodata`` are no data; pixels of which no layer has any are left out.
    """
    value = F.col("value").try_cast(kind)
    held = layers.select("row", "col", F.col(order).alias("_order"), value.alias("value")).where(F.col("value").isNotNull())
    held = held if nodata is None else held.where(F.col("value") != F.lit(nodata))
    return held.groupBy("row", "col").agg(F.max_by("value", F.struct("_order", "value")).alias("value"))
