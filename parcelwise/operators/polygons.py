"""Polygons of several rings: filled into runs of pixels, asked for the points they hold, clipped, and rectangles united.

A polygon is rows with ``rings`` ARRAY<ARRAY<STRUCT<x, y>>>, each ring closed or taken to be; what an odd number of rings
surrounds is inside, so a ring within a ring is a hole. All follow one rule: a point is inside if a ray to the right crosses an odd
number of edges, so that left and lower edges belong and polygons that share an edge share no point. Null and empty
rings hold nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cell_size, cells_of

#: Columns that one key of the join of runs with pixels spans.
BLOCK = 64
#: Cells along a polygon of middling size when points are asked.
ACROSS = 16


def sides(ring: Column, of) -> Column:
    """``of`` each two neighbouring corners of a ring, the last and the first too."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), of)


def edges(polygons: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """(keys, ax, ay, bx, by): the edges of all rings that have a length."""
    ring = polygons.select(*keys, F.explode(rings).alias("_ring")).where(F.size("_ring") > 1)
    each = sides(F.col("_ring"), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    return ring.select(*keys, F.inline(each)).where("ax <> bx OR ay <> by")


def crossing(y: Column) -> Column:
    """Where an edge meets a height."""
    return (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")


def first_centre(at: Column, origin: float, step: float) -> Column:
    """The number of the first pixel whose centre is at a coordinate or beyond it, counted along ``step`` > 0."""
    guess = F.ceil((at - origin) / step - 0.5)
    centre = lambda k: origin + (k + 0.5) * step
    # the division may round to either side of a centre
    return (guess + F.when(centre(guess - 1) >= at, -1).when(centre(guess) < at, 1).otherwise(0)).cast("bigint")


def filled_runs(polygons: DataFrame, keys: Sequence[str], affine: Sequence[float], rings: str = "rings") -> DataFrame:
    """(keys, row, first, last): the runs of pixels whose centres each polygon holds, row by row.

    Scanlines: every edge is met with the centres of the rows it spans, and the crossings of a row, in order, open and
    close runs by turns. Rows and columns may lie outside of any raster. ``affine``: (ul_x, x_res, 0, ul_y, 0, y_res),
    y_res of either sign.
    """
    ul_x, x_res, _, ul_y, _, y_res = affine
    side = edges(polygons, keys, rings).where("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    # centres from the lower end on and before the upper one, as the ray rule has it
    if y_res > 0:
        first, last = first_centre(low, ul_y, y_res), first_centre(high, ul_y, y_res) - 1
    else:  # counted downward: centres at or above the lower end are those before the first one below it
        upward = lambda at: -first_centre(at, ul_y, -y_res) - 1
        first, last = upward(high) + 1, upward(low)
    rows = side.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    met = rows.select(*keys, "row", crossing(ul_y + (F.col("row") + 0.5) * y_res).alias("_x"))
    ordered = met.groupBy(*keys, "row").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    pair = F.expr("transform(sequence(0, cast(size(_x) / 2 as int) - 1), k -> struct(_x[2 * k] AS a, _x[2 * k + 1] AS b))")
    runs = ordered.select(*keys, "row", F.inline(pair))
    runs = runs.select(*keys, "row", first_centre(F.col("a"), ul_x, x_res).alias("first"), (first_centre(F.col("b"), ul_x, x_res) - 1).alias("last"))
    return runs.where("first <= last")


def pixels_in(pixels: DataFrame, polygons: DataFrame, keys: Sequence[str], affine: Sequence[float], rings: str = "rings") -> DataFrame:
    """All pairs of a pixel (row, col) and a polygon that holds its centre: the pixel's columns and the polygon's keys.

    Runs meet pixels by row and block of columns, so a row of any length is many keys and no polygon is tested twice.
    """
    runs = filled_runs(polygons, keys, affine, rings)
    blocks = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK)))).withColumnRenamed("row", "_row")
    placed = pixels.withColumn("_at", F.floor(F.col("col") / BLOCK))
    held = placed.join(blocks, (F.col("_at") == F.col("_block")) & (F.col("row") == F.col("_row"))).where("col BETWEEN first AND last")
    return held.drop("_at", "_block", "_row", "first", "last")


def inside(x: Column, y: Column, rings: Column) -> Column:
    """The ray rule over all rings."""
    each = F.flatten(F.transform(rings, lambda r: F.when(F.size(r) > 1, sides(r, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())))
    at = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    return F.size(F.filter(each, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < at(e)))) % 2 == 1


def covering_cells(polygons: DataFrame, key: str, size: float, rings: str = "rings") -> DataFrame:
    """(key, cell_x, cell_y, border): the cells an edge passes through, and those wholly inside; all others are outside."""
    side = edges(polygons, [key], rings)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = side.select("*", cells_of(low, high, size).alias("cell_y"))
    flat = F.col("ay") == F.col("by")
    lower, upper = F.greatest(low, F.col("cell_y") * size), F.least(high, (F.col("cell_y") + 1) * size)
    # a hair wider, so that rounding can't leave out a cell
    at = lambda y: F.when(flat, F.col("ax")).otherwise(crossing(y))
    ends = [F.when(flat, F.col("ax")).otherwise(at(lower)), F.when(flat, F.col("bx")).otherwise(at(upper))]
    hair = F.lit(size * 1e-9)
    border = rows.select(key, "cell_y", cells_of(F.least(*ends) - hair, F.greatest(*ends) + hair, size).alias("cell_x")).distinct()
    runs = filled_runs(polygons, [key], (0, size, 0, 0, 0, size), rings).select(key, F.col("row").alias("cell_y"), F.explode(F.sequence("first", "last")).alias("cell_x"))
    whole = runs.join(border.hint("merge"), [key, "cell_x", "cell_y"], "left_anti").withColumn("border", F.lit(False))
    return border.withColumn("border", F.lit(True)).unionByName(whole)


def points_in(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings", size: float | None = None) -> DataFrame:
    """All pairs of a point (x, y) and a polygon that holds it: the point's columns and the polygon's key.

    Points meet cells of ``size``. In a cell wholly inside of a polygon they belong to it without a test; rays are cast
    in the cells of its border alone, against its rings.
    """
    if size is None:
        every = F.flatten(F.transform(rings, lambda r: r))
        at = lambda f, c: f(F.transform(every, lambda p: p[c]))
        boxes = polygons.select(at(F.array_min, "x").alias("ul_x"), at(F.array_max, "x").alias("lr_x"), at(F.array_max, "y").alias("ul_y"), at(F.array_min, "y").alias("lr_y"))
        size = cell_size(boxes) * 2 / ACROSS
    cells = covering_cells(polygons, key, size, rings)
    placed = points.withColumns({"cell_x": F.floor(F.col("x") / size), "cell_y": F.floor(F.col("y") / size)})
    # Spark takes what is exploded to be no larger than what it comes from, and would send it whole through the driver
    met = placed.join(cells.hint("merge"), ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    whole = met.where(~F.col("border")).drop("border")
    cast = met.where("border").join(polygons.select(key, F.col(rings).alias("_rings")).hint("merge"), key)
    cast = cast.where(inside(F.col("x").cast("double"), F.col("y").cast("double"), F.col("_rings")))
    return whole.unionByName(cast.drop("border", "_rings"))


def ring_area(ring: Column) -> Column:
    """The area that a closed ring surrounds, positive if its corners run against the clock; 0 of null and empty rings."""
    each = sides(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) > 2, F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(0.0)


def half_plane(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """What of a closed ring lies at or beyond a bound on one axis: corners inside stay, and edges that cross are cut."""
    other = "y" if axis == "x" else "x"
    holds = lambda p: p[axis] >= bound if above else p[axis] <= bound

    def cut(a: Column, b: Column) -> Column:
        share = (bound - a[axis]) / (b[axis] - a[axis])
        at = {axis: bound, other: a[other] + share * (b[other] - a[other])}
        return F.struct(at["x"].cast("double").alias("x"), at["y"].cast("double").alias("y"))

    def kept(a: Column, b: Column) -> Column:
        crossing = F.when(holds(a) != holds(b), F.array(cut(a, b))).otherwise(F.array())
        return F.concat(crossing, F.when(holds(b), F.array(b)).otherwise(F.array()))

    out = F.flatten(sides(ring, kept))
    return F.when(F.size(ring) > 1, F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out)).otherwise(ring)


def clipped_rings(df: DataFrame, rings: str, ul_x: str, ul_y: str, lr_x: str, lr_y: str) -> DataFrame:
    """``df`` with its rings cut to the window that four columns give, one half-plane after another; areas and the ray rule hold for what is left."""
    bounds = [("x", ul_x, True), ("x", lr_x, False), ("y", lr_y, True), ("y", ul_y, False)]
    for axis, bound, above in bounds:  # a column a step, else each would hold the last one many times over
        df = df.withColumn(rings, F.filter(clipped_by(rings, axis, bound, above), lambda r: F.size(r) > 3))
    return df


def clipped_by(rings: str, axis: str, bound: str, above: bool) -> Column:
    return F.transform(rings, lambda r: half_plane(r, axis, F.col(bound).cast("double"), above))


def shared_with_rects(polygons: DataFrame, rects: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, id, area, rings): what each polygon shares with each rectangle (id and corners; y upward), where that has an area.

    Pairs meet on the cells that a polygon's edges pass or that lie inside it, so rectangles far from it are never cut.
    """
    size = cell_size(rects)
    cells = covering_cells(polygons, key, size, rings).select(key, "cell_x", "cell_y")
    placed = rects.select("*", cells_of(F.col("ul_x"), F.col("lr_x"), size).alias("cell_x")).select("*", cells_of(F.col("lr_y"), F.col("ul_y"), size).alias("cell_y"))
    near = placed.join(cells, ["cell_x", "cell_y"]).drop("cell_x", "cell_y").distinct()
    pairs = near.join(polygons.select(key, F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).alias("rings")), key)
    cut = clipped_rings(pairs, "rings", "ul_x", "ul_y", "lr_x", "lr_y")
    area = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda s, v: s + v)
    return cut.select(key, "id", F.abs(area).alias("area"), "rings").where("area > 0")


def united(rects: DataFrame, by: str, size: float | None = None) -> DataFrame:
    """(by, ul_x, ul_y, lr_x, lr_y): rectangles without overlap that cover what the rectangles of each value cover, so that areas count once.

    A sweep over compressed coordinates: rectangles are cut at the cells they touch; within a cell the distinct left and
    right edges bound slabs, and in each slab the rectangles' heights, in order, merge to pieces. Equal cuts count once,
    so a value with very many rectangles is spread over its cells. Rectangles without area add nothing.
    """
    whole = rects.where("ul_x < lr_x AND lr_y < ul_y")
    size = size or cell_size(whole)
    cells = whole.select("*", cells_of(F.col("ul_x"), F.col("lr_x"), size).alias("cell_x")).select("*", cells_of(F.col("lr_y"), F.col("ul_y"), size).alias("cell_y"))
    west, south = F.col("cell_x") * size, F.col("cell_y") * size
    cell = [by, "cell_x", "cell_y"]
    parts = cells.select(*cell, F.greatest("ul_x", west).alias("x0"), F.least("lr_x", west + size).alias("x1"), F.greatest("lr_y", south).alias("y0"), F.least("ul_y", south + size).alias("y1"))
    parts = parts.where("x0 < x1 AND y0 < y1").distinct()
    cuts = parts.select(*cell, F.explode(F.array("x0", "x1")).alias("s0")).distinct()
    slabs = cuts.withColumn("s1", F.lead("s0").over(Window.partitionBy(*cell).orderBy("s0"))).where("s1 IS NOT NULL")
    spans = slabs.join(parts, cell).where("x0 <= s0 AND s1 <= x1").select(*cell, "s0", "s1", "y0", "y1").distinct()
    slab = Window.partitionBy(*cell, "s0").orderBy("y0", "y1")
    below = F.max("y1").over(slab.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(below >= F.col("y0"), 0).otherwise(1)).withColumn("_piece", F.sum("_new").over(slab))
    pieces = marked.groupBy(*cell, "s0", "s1", "_piece").agg(F.min("y0").alias("lr_y"), F.max("y1").alias("ul_y"))
    return pieces.select(by, F.col("s0").alias("ul_x"), "ul_y", F.col("s1").alias("lr_x"), "lr_y")
