"""Predictor tables for training and prediction: rasters joined by pixel, nodata painted in, constants beside them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rasters = Mapping[str, tuple[DataFrame, float | None]]


def of_tile(pixels: DataFrame, rasters: Rasters, nodata: int, kind: str = "smallint") -> DataFrame:
    """Pixels (row, col and what else they have) with one column of type ``kind`` for each raster (row, col, value), in order of name.

    Each raster comes with its own nodata value; that, pixels it lacks and values that ``kind`` can't hold become
    ``nodata``. Name a wider type for rasters beyond it. All rasters are joined on
    the same keys, so one shuffle of each is all that it takes.
    """
    out = pixels
    for name in sorted(rasters):
        raster, own = rasters[name]
        value = F.col("value") if own is None else F.when(F.col("value") != own, F.col("value"))
        out = out.join(raster.select("row", "col", value.try_cast(kind).alias(name)), ["row", "col"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(nodata)).cast(kind) for n in sorted(rasters)})


def with_constants(rows: DataFrame, constants: Mapping[str, int]) -> DataFrame:
    """Constant columns, appended in order of name."""
    return rows.withColumns({n: F.lit(constants[n]) for n in sorted(constants)})


def valid(rows: DataFrame, names, nodata: int, any_missing: bool = True) -> DataFrame:
    """Rows without a missing predictor, or (``any_missing=False``) those that have at least one."""
    present = [F.col(n) != nodata for n in names]
    keep = present[0]
    for p in present[1:]:
        keep = keep & p if any_missing else keep | p
    return rows.where(keep)


def split_complete(rows: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """Rows that have every column, and the others."""
    missing = F.lit(False)
    for n in names:
        missing |= F.col(n).isNull()
    return rows.where(~missing), rows.where(missing)
