"""Neighbourhood operations: at samples as joins with a short table of offsets, over whole rasters by squares with a rim."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ensemble import STATISTICS


def square(side: int) -> list[tuple[int, int]]:
    r = side // 2
    return [(i, j) for i in range(-r, side - r) for j in range(-r, side - r)]


def circle(diameter: int) -> list[tuple[int, int]]:
    r = diameter // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]


def offsets(df: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    """Every pixel beside the place (k: its number, row by row from the upper left) of each of its neighbours."""
    places = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(footprint)])
    out = df.select("row", "col", F.explode(places).alias("o"))
    return out.select("row", "col", F.col("o.k").alias("k"), (F.col("row") + F.col("o.i")).alias("n_row"), (F.col("col") + F.col("o.j")).alias("n_col"))


def sorted_mode(stack: np.ndarray) -> np.ndarray:
    """The most frequent value along the first axis, the smallest on a tie; NaN doesn't count."""
    ordered = np.sort(stack, axis=0)
    best, most, run = ordered[0].copy(), np.ones(ordered[0].shape, np.int64), np.ones(ordered[0].shape, np.int64)
    for k in range(1, len(ordered)):
        run = np.where(ordered[k] == ordered[k - 1], run + 1, 1)
        better = (run > most) & ~np.isnan(ordered[k])
        best, most = np.where(better, ordered[k], best), np.where(better, run, most)
    return best


def mean_of(stack: np.ndarray) -> np.ndarray:
    return np.nansum(stack, axis=0) / np.maximum((~np.isnan(stack)).sum(axis=0), 1)


#: Focal statistics by name: of the neighbours' values along the first axis and the pixels' own; and the type of the result, None for that of the values.
FOCAL: dict[str, tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], str | None]] = {
    "mean": (lambda near, own: mean_of(near), "double"),
    "mode": (lambda near, own: sorted_mode(near), None),
    "pct_nonzero": (lambda near, own: 100 * ((near != 0) & ~np.isnan(near)).sum(axis=0) / np.maximum((~np.isnan(near)).sum(axis=0), 1), "double"),
    "uniform": (lambda near, own: ((near == own) | np.isnan(near)).all(axis=0), "boolean"),
}
#: Pixels along a side of the squares that tasks work on, and rows of one that are stacked at a time.
SIDE, STRIP = 256, 16


def in_squares(pixels: DataFrame, reach: int, side: int) -> DataFrame:
    """Pixels with ``tile_row`` and ``tile_col`` of each square that they lie in or within ``reach`` of."""
    squares = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - reach, F.lit(0)) / side), F.floor((F.col(c) + reach) / side)))
    return pixels.select("*", squares("row").alias("tile_row")).select("*", squares("col").alias("tile_col"))


def focal(raster: DataFrame, footprint: list[tuple[int, int]], name: str, side: int = SIDE) -> DataFrame:
    """(row, col, value) of one focal statistic, edges mirrored; null pixels stay null and don't count.

    Pixels are dealt to squares of ``side`` by ``side`` with a rim as wide as the footprint reaches, so only those near a
    border go to more than one; a task shifts its square under the footprint. Squares are of one size, however large the
    raster. Values are taken as doubles.
    """
    reach = max(max(abs(i), abs(j)) for i, j in footprint)
    if reach > side:
        raise ValueError(f"a footprint may reach {side} pixels")
    function, kind = FOCAL[name]
    size = F.broadcast(raster.agg((F.max("row") + 1).alias("y_size"), (F.max("col") + 1).alias("x_size")))  # one row
    dealt = in_squares(raster.select("row", "col", F.col("value").cast("double").alias("value")), reach, side).crossJoin(size)
    schema = raster.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(0.0).alias("value")).schema

    def shifted(table: pa.Table) -> pa.Table:
        row, col, value = table["row"].to_numpy(), table["col"].to_numpy(), table["value"].to_numpy(zero_copy_only=False)
        top, left = table["tile_row"][0].as_py() * side, table["tile_col"][0].as_py() * side
        y_size, x_size = table["y_size"][0].as_py(), table["x_size"][0].as_py()
        height, width = min(side, y_size - top), min(side, x_size - left)
        none = pa.table({"row": pa.array([], pa.int64()), "col": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        if height <= 0 or width <= 0:
            return none
        held = np.full((height + 2 * reach, width + 2 * reach), np.nan)
        inside = (row < top + height + reach) & (col < left + width + reach)
        held[row[inside] - top + reach, col[inside] - left + reach] = value[inside]
        mirrored = lambda at, n: np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - 1 - at, at))
        # beyond the raster's edge stand the pixels before it
        held = held[np.clip(mirrored(np.arange(top - reach, top + height + reach), y_size) - top + reach, 0, len(held) - 1)]
        held = held[:, np.clip(mirrored(np.arange(left - reach, left + width + reach), x_size) - left + reach, 0, held.shape[1] - 1)]
        own = held[reach : reach + height, reach : reach + width]
        out = np.empty((height, width))
        for at in range(0, height, STRIP):
            n = min(STRIP, height - at)
            near = np.stack([held[at + reach + i : at + reach + i + n, reach + j : reach + j + width] for i, j in footprint])
            out[at : at + n] = function(near, own[at : at + n])
        r, c = np.nonzero(~np.isnan(own))
        return pa.table({"row": pa.array(r + top, pa.int64()), "col": pa.array(c + left, pa.int64()), "value": pa.array(out[r, c], pa.float64())})

    found = dealt.groupBy("tile_row", "tile_col").applyInArrow(lambda table: shifted(table), schema)
    types = dict(raster.dtypes)
    return found.select(F.col("row").cast(types["row"]).alias("row"), F.col("col").cast(types["col"]).alias("col"), F.col("value").cast(kind or types["value"]).alias("value"))


def kernel_columns(raster: DataFrame, samples: DataFrame, name: str) -> DataFrame:
    """Samples with the nine values around each as name_1 to name_9, row by row."""
    near = neighbours_of(samples, raster)
    return near.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"{name}_{k}") for k in range(1, 10)])


def neighbours_of(samples: DataFrame, raster: DataFrame, footprint: list[tuple[int, int]] | None = None) -> DataFrame:
    """(row, col, k, value) of the values around each sample, by default three by three; null where the raster has none."""
    held = raster.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), "value")
    return offsets(samples, footprint or square(3)).join(held, ["n_row", "n_col"], "left").select("row", "col", "k", "value")


def rectangle(height: int, width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-(height // 2), height - height // 2) for j in range(-(width // 2), width - width // 2)]


def windows(samples: DataFrame, raster: DataFrame, height: int, width: int, nodata) -> DataFrame:
    """(row, col, k, value) of the window of so many rows and columns centred on each sample; ``nodata`` where the raster has none."""
    near = neighbours_of(samples, raster, rectangle(height, width))
    return near.withColumn("value", F.coalesce("value", F.lit(nodata)))


def kernel_modes(raster: DataFrame, samples: DataFrame) -> DataFrame:
    """For discrete values: the most frequent of the nine around each sample, the smallest on a tie, and how many they are."""
    counts = neighbours_of(samples, raster).where("value IS NOT NULL").groupBy("row", "col", "value").agg(F.count("*").alias("n"))
    best = F.max_by("value", F.struct("n", -F.col("value")))
    return counts.groupBy("row", "col").agg(best.alias("mode"), F.max("n").alias("count"))


def paired_means(samples: DataFrame, raster: DataFrame, other: DataFrame) -> DataFrame:
    """(row, col, pred, ref): the whole means of the windows of two rasters at each sample that has the first."""
    of = lambda r, name: neighbours_of(samples, r).groupBy("row", "col").agg(F.avg("value").cast("int").alias(name))
    return of(raster, "pred").where("pred IS NOT NULL").join(of(other, "ref"), ["row", "col"])


def kernel_statistics(raster: DataFrame, samples: DataFrame, names=("mean", "median", "variance", "stdv", "range")) -> DataFrame:
    near = neighbours_of(samples, raster)
    exact = {"stdv": F.stddev_pop, "median": F.median, "mean": lambda v: F.avg(v).cast("int")}
    return near.groupBy("row", "col").agg(*[(exact.get(n) or STATISTICS[n])(F.col("value")).alias(n) for n in names])


def best_match(samples: DataFrame, reference: DataFrame, predicted: str = "pred") -> DataFrame:
    """For each sample the reference value of its 3 by 3 window nearest to its prediction, the first row by row on a tie."""
    near = neighbours_of(samples, reference).where("value IS NOT NULL")
    joined = near.join(samples.select("row", "col", predicted), ["row", "col"])
    return joined.groupBy("row", "col").agg(F.first(predicted).alias(predicted), F.min_by("value", F.struct(F.abs(F.col("value") - F.col(predicted)), "k")).alias("matched"))


def match_raster(predicted: DataFrame, reference: DataFrame, side: int = SIDE) -> DataFrame:
    """(row, col, pred, matched): for each pixel of a raster the reference value of the three by three around it nearest to its own, the first row by row on a tie.

    Whole values; both rasters are dealt to squares with a rim, as in ``focal``. Pixels without a reference value around
    them are left out, as are null ones.
    """
    one = predicted.where(F.col("value").isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), F.lit(True).alias("own"))
    other = reference.where(F.col("value").isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), F.lit(False).alias("own"))
    dealt = in_squares(one.unionByName(other), 1, side)

    def nearest(table: pa.Table) -> pa.Table:
        top, left = table["tile_row"][0].as_py() * side, table["tile_col"][0].as_py() * side
        row, col, value, own = (table[c].to_numpy(zero_copy_only=False) for c in ("row", "col", "value", "own"))
        layers = np.full((2, side + 2, side + 2), np.nan)
        layers[np.where(own, 0, 1), row - top + 1, col - left + 1] = value
        pred = layers[0, 1:-1, 1:-1]
        best, least = np.full(pred.shape, np.nan), np.full(pred.shape, np.inf)
        for i, j in square(3):
            near = layers[1, 1 + i : 1 + i + side, 1 + j : 1 + j + side]
            apart = np.abs(near - pred)
            closer = apart < least
            best, least = np.where(closer, near, best), np.where(closer, apart, least)
        r, c = np.nonzero(~np.isnan(best))
        return pa.table({"row": pa.array(r + top, pa.int64()), "col": pa.array(c + left, pa.int64()), "pred": pa.array(pred[r, c].astype(np.int64)), "matched": pa.array(best[r, c].astype(np.int64))})

    found = dealt.groupBy("tile_row", "tile_col").applyInArrow(lambda table: nearest(table), "row long, col long, pred long, matched long")
    kind = dict(predicted.dtypes)
    return found.select(F.col("row").cast(kind["row"]).alias("row"), F.col("col").cast(kind["col"]).alias("col"), F.col("pred").cast(kind["value"]).alias("pred"), F.col("matched").cast(dict(reference.dtypes)["value"]).alias("matched"))


def surroundings(raster: DataFrame, side: int = SIDE) -> DataFrame:
    """(row, col, z_1 to z_9): the values of the three by three around each pixel that has all nine, row by row, as doubles; pixels are dealt to squares with a rim, as in ``focal``."""
    dealt = in_squares(raster.where(F.col("value").isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), 1, side)
    names = [f"z_{k}" for k in range(1, 10)]

    def around(table: pa.Table) -> pa.Table:
        top, left = table["tile_row"][0].as_py() * side, table["tile_col"][0].as_py() * side
        row, col, value = (table[c].to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
        held = np.full((side + 2, side + 2), np.nan)
        held[row - top + 1, col - left + 1] = value
        near = np.stack([held[1 + i : 1 + i + side, 1 + j : 1 + j + side] for i, j in square(3)])
        r, c = np.nonzero(~np.isnan(near).any(axis=0))
        return pa.table({"row": pa.array(r + top, pa.int64()), "col": pa.array(c + left, pa.int64()), **{n: pa.array(near[k, r, c]) for k, n in enumerate(names)}})

    kinds = dict(raster.dtypes)
    found = dealt.groupBy("tile_row", "tile_col").applyInArrow(lambda table: around(table), "row long, col long, " + ", ".join(f"{n} double" for n in names))
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("row", "col")})


def curvature(raster: DataFrame, resolution: float) -> DataFrame:
    """(row, col, curvature): -200 (D + E) of the quadratic surface through a pixel and its four neighbours."""
    z = surroundings(raster)
    c = {k: F.col(f"z_{k}") for k in range(1, 10)}
    area = resolution * resolution
    d, e = ((c[4] + c[6]) / 2 - c[5]) / area, ((c[2] + c[8]) / 2 - c[5]) / area
    return z.select("row", "col", (-200 * (d + e)).alias("curvature"))


def slope_aspect(raster: DataFrame, resolution: float) -> DataFrame:
    """(row, col, slope, aspect) in degrees by Horn's method for pixels with all nine values."""
    z = surroundings(raster)
    c = {k: F.col(f"z_{k}") for k in range(1, 10)}
    dx = (c[3] + 2 * c[6] + c[9] - c[1] - 2 * c[4] - c[7]) / (8 * resolution)
    dy = (c[7] + 2 * c[8] + c[9] - c[1] - 2 * c[2] - c[3]) / (8 * resolution)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    return z.select("row", "col", slope.alias("slope"), F.pmod(F.degrees(F.atan2(dy, -dx)) * -1 + 450, F.lit(360.0)).alias("aspect"))
