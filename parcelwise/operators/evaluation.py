"""The whole evaluation of a predicted map against a reference, by pixel, class, bin and zone, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_number
from ..session import cut
from . import accuracy, polygons


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bin_x, bin_y, n): counts in equal bins between the least and the greatest value of each series, the last one closed; a constant series has one bin."""
    ends = rows.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()  # one row
    number = lambda c, low, high: F.least(F.floor((F.col(c) - low) * bins / (high - low)), F.lit(bins - 1)) if low is not None and high > low else F.lit(0)
    return rows.groupBy(number(x, ends[0], ends[1]).cast("int").alias("bin_x"), number(y, ends[2], ends[3]).cast("int").alias("bin_y")).agg(F.count("*").alias("n"))


def evaluate(pixels: DataFrame, edges: Sequence[tuple[int, int]], zones: dict[str, DataFrame], affine: Sequence[float], masked: Column | None = None, nodata: tuple[float | None, float | None] = (None, None), bins: int = 50) -> dict[str, DataFrame]:
    """Tables by name of a map's pixels (row, col, pred, ref, cover, sampled).

    Pixels that are masked, or whose prediction or reference is null or its ``nodata``, take no part. ``difference``:
    prediction less reference by pixel; ``histogram``: both series in two dimensions; ``classes`` and ``bins``: agreement
    within each cover class but 0, and within each of ``edges`` that both series lie in; ``matrix``: the confusion matrix
    of the sample adjusted by area; for each table of polygons in ``zones`` (zone, rings), one a scale, ``zones_<scale>``: both
    series and their difference over the pixels whose centres a zone holds.
    """
    kept = F.col("pred").isNotNull() & F.col("ref").isNotNull()
    for c, none in zip(("pred", "ref"), nodata, strict=True):
        kept &= F.lit(True) if none is None else F.col(c) != none
    held = cut(pixels.where(kept if masked is None else kept & ~F.coalesce(masked, F.lit(False))).withColumn("difference", F.col("pred") - F.col("ref")))
    numbered = held.withColumns({"p": bin_number(F.col("pred"), edges), "r": bin_number(F.col("ref"), edges)})
    covered = held.where("cover <> 0")
    out = {
        "difference": held.select("row", "col", "difference"),
        "histogram": histogram_2d(held, "ref", "pred", bins),
        "classes": accuracy.agreement(covered, "ref", "pred", ["cover"]).join(accuracy.errors(covered, "ref", "pred", ["cover"]).select("cover", "rmspe"), "cover"),
        "bins": accuracy.agreement(numbered.where("p = r"), "ref", "pred", ["p"]).withColumnRenamed("p", "bin"),
        "matrix": accuracy.by_area(numbered, "p", "r", "sampled"),
    }
    for scale, shapes in zones.items():
        within = polygons.pixels_in(held, shapes, ["zone"], affine)
        out[f"zones_{scale}"] = within.groupBy("zone").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in ("pred", "ref", "difference")], F.stddev_pop("difference").alias("difference_stdv"))
    return out


def write_evaluation(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table in a folder of its own: the difference map as Parquet, all others, which are small, as text."""
    for name, table in tables.items():
        if name == "difference":
            table.write.parquet(f"{folder}/{name}")
        else:
            table.write.csv(f"{folder}/{name}", sep="\t", header=True)


def melted(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """(part, key, measure, value) of all tables but the difference map: one long report."""
    out = None
    for name, table in tables.items():
        if name not in keys:
            continue
        key = F.concat_ws("_", *[F.col(c).cast("string") for c in keys[name]])
        each = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in table.columns if c not in keys[name]])
        own = table.select(F.lit(name).alias("part"), key.alias("key"), F.inline(each))
        out = own if out is None else out.unionByName(own)
    return out
