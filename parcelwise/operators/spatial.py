"""Containment, overlap, adjacency and nearest joins over points, rectangles and rings.

Range joins meet on coarse grid cells: a point lies in one cell, a rectangle is repeated for each cell it touches, and
an equi-join on the cell leaves few candidates to the exact test. A pair of rectangles is kept in one cell only, the
one that holds the lower left corner of what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def cells_of(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def by_cell(rects: DataFrame, size: float) -> DataFrame:
    """Rectangles (ul_x, ul_y, lr_x, lr_y; y upward) repeated for each cell they touch."""
    out = rects.select("*", cells_of(F.col("ul_x"), F.col("lr_x"), size).alias("cell_x"))
    return out.select("*", cells_of(F.col("lr_y"), F.col("ul_y"), size).alias("cell_y"))


#: Cells a rectangle of middling size touches along a side, about; how much wider the cells of a level are than those of the one before, and levels.
ACROSS, WIDER, LEVELS = 2, 16, 4


def longer_side() -> Column:
    return F.greatest(F.col("lr_x") - F.col("ul_x"), F.col("ul_y") - F.col("lr_y"))


def cell_size(*rects: DataFrame) -> float:
    """A width of cells that suits the extents of rectangles: half the mean of their longer sides, so one touches a few cells whatever the map's units."""
    sides = [r.agg(F.avg(longer_side()), F.max(longer_side())).first() for r in rects]  # one row each
    held = [(float(mean), float(most)) for mean, most in sides if mean]
    # the mean alone would cut a few huge ones among many small ones into too many cells
    return max([1e-9, *(max(mean / ACROSS, most / 64) for mean, most in held)])


def cell_sizes(*rects: DataFrame) -> list[float]:
    """Widths of cells by level, for rectangles of mixed extents: the first suits those of middling size, each next one is ``WIDER``, and the last the largest; one level where all are much alike."""
    sides = [r.where(longer_side() > 0).agg(F.percentile_approx(longer_side().cast("double"), 0.5, 1000), F.max(longer_side())).first() for r in rects]  # one row each
    held = [(float(middle), float(most)) for middle, most in sides if middle]
    if not held:
        return [1.0]
    sizes, most = [min(middle for middle, _ in held) / ACROSS], max(most for _, most in held)
    while len(sizes) < LEVELS and most > WIDER * ACROSS * sizes[-1]:
        sizes.append(sizes[-1] * WIDER)
    sizes[-1] = max(sizes[-1], most / 64)
    return sizes


def level_of(sizes: list[float]) -> Column:
    """The level whose cells suit a rectangle: the first of which it touches a few, the last for the largest."""
    out = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        out = F.when(longer_side() <= WIDER * ACROSS * sizes[k], k).otherwise(out)
    return out


def on_levels(rects: DataFrame, sizes: list[float], coarser: bool = False) -> DataFrame:
    """Rectangles with ``level``, ``size``, ``cell_x`` and ``cell_y`` of each cell they touch at their own level, or at it and all ``coarser`` ones."""
    last = F.lit(len(sizes) - 1)
    own = rects.withColumn("_own", level_of(sizes))
    each = own.withColumn("level", F.explode(F.sequence("_own", last)) if coarser else F.col("_own"))
    sized = each.withColumn("size", F.get(F.array(*map(F.lit, sizes)), F.col("level")))
    wide = sized.select("*", F.explode(F.sequence(F.floor(F.col("ul_x") / F.col("size")), F.floor(F.col("lr_x") / F.col("size")))).alias("cell_x"))
    return wide.select("*", F.explode(F.sequence(F.floor(F.col("lr_y") / F.col("size")), F.floor(F.col("ul_y") / F.col("size")))).alias("cell_y"))


#: Tests of a point in a rectangle: strict on all sides; half-open (left and upper edge belong).
WITHIN = {
    "strict": lambda x, y: (x > F.col("ul_x")) & (x < F.col("lr_x")) & (y > F.col("lr_y")) & (y < F.col("ul_y")),
    "half_open": lambda x, y: (x >= F.col("ul_x")) & (x < F.col("lr_x")) & (y > F.col("lr_y")) & (y <= F.col("ul_y")),
}


def points_in_rects(points: DataFrame, rects: DataFrame, rule: str, size: float | None = None) -> DataFrame:
    """All pairs of a point (x, y) and a rectangle that holds it by a rule of ``WITHIN``.

    Rectangles lie on cells that suit their extent, small ones and huge ones on levels of their own; a point lies in one
    cell of each level.
    """
    sizes = [size] if size else cell_sizes(rects)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / s).alias("cell_x"), F.floor(F.col("y") / s).alias("cell_y")) for k, s in enumerate(sizes)]))
    placed = points.select("*", at.alias("_at")).select(*points.columns, "_at.*")
    cells = on_levels(rects, sizes).drop("_own", "size")
    return placed.join(cells, ["level", "cell_x", "cell_y"]).where(WITHIN[rule](F.col("x"), F.col("y"))).drop("level", "cell_x", "cell_y")


def rect_pairs(left: DataFrame, right: DataFrame, touching: bool, size: float | None = None) -> DataFrame:
    """(left_id, right_id, area) of rectangles (id and corners) that share an area, or with ``touching`` a point at least.

    A rectangle lies on the cells of the level that suits its extent and of all coarser ones; a pair meets at the coarser
    level of its two, in the cell that holds the lower left corner of what they share.
    """
    names = ("ul_x", "ul_y", "lr_x", "lr_y")
    sizes = [size] if size else cell_sizes(left, right)
    side = lambda r, name, short: on_levels(r, sizes, True).select("level", "size", "cell_x", "cell_y", F.col("_own").alias(f"{short}_own"), F.col("id").alias(name), *[F.col(n).alias(f"{short}_{n}") for n in names])
    a, b = side(left, "left_id", "a"), side(right, "right_id", "b").drop("size")
    x, y = F.greatest("a_ul_x", "b_ul_x"), F.greatest("a_lr_y", "b_lr_y")
    width, height = F.least("a_lr_x", "b_lr_x") - x, F.least("a_ul_y", "b_ul_y") - y
    near = (width >= 0) & (height >= 0) if touching else (width > 0) & (height > 0)
    once = (F.floor(x / F.col("size")) == F.col("cell_x")) & (F.floor(y / F.col("size")) == F.col("cell_y")) & (F.greatest("a_own", "b_own") == F.col("level"))
    return a.join(b, ["level", "cell_x", "cell_y"]).where(near & once).select("left_id", "right_id", (width * height).alias("area"))


def touching_components(rects: DataFrame, size: float | None = None) -> DataFrame:
    """(id, region_id): rectangles that share an edge or corner without area, and all they reach, under their smallest id.

    Each round is checkpointed to the shared folder; a count of changes alone comes to the driver.
    """
    links = cut(rect_pairs(rects, rects, True, size).where("left_id <> right_id AND area = 0").select("left_id", "right_id"))
    labels = rects.select("id", F.col("id").alias("region_id"))
    while True:
        around = links.join(labels.withColumnRenamed("id", "right_id"), "right_id").groupBy(F.col("left_id").alias("id")).agg(F.min("region_id").alias("least"))
        new = labels.join(around, "id", "left").select("id", F.least("region_id", F.coalesce("least", "region_id")).alias("next"), "region_id")
        # one more step along the labels halves the rounds
        jump = new.select(F.col("id").alias("next"), F.col("next").alias("further"))
        new = cut(new.join(jump, "next", "left").select("id", F.least("next", F.coalesce("further", "next")).alias("next"), "region_id"))
        changed = new.where("next <> region_id").count()
        labels = new.select("id", F.col("next").alias("region_id"))
        if not changed:
            return labels


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring ARRAY<STRUCT<x, y>> by casting a ray to the right; its left and lower edges belong."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_of(ul_x: Column, ul_y: Column, lr_x: Column, lr_y: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(ul_x, ul_y), corner(lr_x, ul_y), corner(lr_x, lr_y), corner(ul_x, lr_y), corner(ul_x, ul_y))


def nearest(values: DataFrame, coordinates: DataFrame, value: str, coordinate: str) -> DataFrame:
    """Each row of ``values`` with its nearest coordinate, the smaller on a tie.

    Values are counted once each and sorted together with the coordinates; the last coordinate before and the first one
    after each value follow from running extremes within ranges of the sort and, from range to range, over one row each.
    """
    distinct = values.select(F.col(value).alias("at")).where(F.col(value).isNotNull()).distinct()
    own = coordinates.select(F.col(coordinate).alias("at"), F.col(coordinate).alias("edge")).where(F.col(coordinate).isNotNull()).distinct()
    both = distinct.withColumn("edge", F.lit(None).cast(own.schema["edge"].dataType)).unionByName(own)
    # an edge sorts before a value equal to it
    ranged = cut(both.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("edge").alias("last"), F.min("edge").alias("first"))  # one row a partition
    before, after = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("part", F.max("last").over(before).alias("part_low"), F.min("first").over(after).alias("part_high"))
    line = Window.partitionBy("part").orderBy("at", F.col("edge").asc_nulls_last())
    low = F.max("edge").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the same line backward: a frame that ends with the partition would be read anew for each row
    back = Window.partitionBy("part").orderBy(F.desc("at"), F.col("edge").desc_nulls_first())
    high = F.min("edge").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumns({"low": low, "high": high}).join(F.broadcast(ends), "part").where("edge IS NULL")
    low, high = F.coalesce("low", "part_low"), F.coalesce("high", "part_high")
    near = F.when(high.isNull() | (F.col("at") - low <= high - F.col("at")), low).otherwise(high)
    return values.join(placed.select(F.col("at").alias(value), near.alias("nearest")), value)


def in_envelope(x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon's envelope, half-open; what is left goes on to the ray cast."""
    return (x >= F.col("min_x")) & (x < F.col("max_x")) & (y >= F.col("min_y")) & (y < F.col("max_y"))


def with_envelope(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygons with the least and greatest coordinates of their rings as columns."""
    at = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return polygons.withColumns({"min_x": at(F.array_min, "x"), "max_x": at(F.array_max, "x"), "min_y": at(F.array_min, "y"), "max_y": at(F.array_max, "y")})


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """All pairs of a point (x, y) and a polygon that holds it: envelopes meet points on cells, and a ray is cast for the pairs left."""
    boxes = with_envelope(polygons, ring)
    rects = boxes.withColumns({"ul_x": F.col("min_x"), "lr_x": F.col("max_x"), "ul_y": F.col("max_y"), "lr_y": F.col("min_y")})
    size = cell_size(rects)
    placed = points.withColumns({"cell_x": F.floor(F.col("x") / size), "cell_y": F.floor(F.col("y") / size)})
    pairs = placed.join(by_cell(rects, size), ["cell_x", "cell_y"]).where(in_envelope(F.col("x"), F.col("y")))
    held = pairs.where(in_ring(F.col("x").cast("double"), F.col("y").cast("double"), F.col(ring)))
    return held.drop("cell_x", "cell_y", "ul_x", "ul_y", "lr_x", "lr_y", "min_x", "max_x", "min_y", "max_y")


def clipped(rects: DataFrame, ul_x: float, ul_y: float, lr_x: float, lr_y: float) -> DataFrame:
    """What of each rectangle lies in a window; those that share no area with it are left out."""
    out = rects.withColumns({"ul_x": F.greatest("ul_x", F.lit(ul_x)), "ul_y": F.least("ul_y", F.lit(ul_y)), "lr_x": F.least("lr_x", F.lit(lr_x)), "lr_y": F.greatest("lr_y", F.lit(lr_y))})
    return out.where("ul_x < lr_x AND lr_y < ul_y")


def extents(rects: DataFrame, by: str) -> DataFrame:
    """(by, n, ul_x, ul_y, lr_x, lr_y): the extent of all rectangles of a value."""
    return rects.groupBy(by).agg(F.count("*").alias("n"), F.min("ul_x").alias("ul_x"), F.max("ul_y").alias("ul_y"), F.max("lr_x").alias("lr_x"), F.min("lr_y").alias("lr_y"))


def names_holding(names: DataFrame, ids: DataFrame, name: str, part: str, length: int) -> DataFrame:
    """Pairs of a name and an id of ``length`` characters that stands in it: an equi-join on every run of that length."""
    return with_runs(names, name, part, length).join(ids, part)


def with_runs(names: DataFrame, name: str, part: str, length: int) -> DataFrame:
    """Names repeated for each different run of ``length`` characters in them, as ``part``."""
    runs = F.transform(F.sequence(F.lit(1), F.length(name) - length + 1), lambda k: F.substr(F.col(name), k, F.lit(length)))
    return names.where(F.length(name) >= length).select("*", F.explode(F.array_distinct(runs)).alias(part))


def first_name_holding(names: DataFrame, ids: DataFrame, name: str, part: str, length: int) -> DataFrame:
    """``ids`` that stand in a name, with the first such name; each run meets its first name before it meets ids, so their pairs are never listed."""
    first = with_runs(names.select(name).distinct(), name, part, length).groupBy(part).agg(F.min(name).alias(name))
    return ids.join(first, part)
