"""Queries on polygons: zones filled into pixels, points in polygons with holes, clipped polygons and united rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as evaluate
from ..operators import polygons, sampling, spatial
from ..sources import tables as src
from .common import rounded
from .evaluation import EDGES as EDGES_OF_BINS
from .evaluation import MATRIX, agreement_sql, covers
from .joins import TILES, tiles

sql = src.sql

#: Corners of the zone of a rectangle as eighths of its sides from its upper left corner: five corners, not convex, and a hole.
OUTER, HOLE = [(0, 3), (8, 0), (6, 8), (4, 5), (1, 7)], [(3, 3), (5, 2), (4, 4)]


def zones(spark, d):
    """``supplier`` as polygons of five corners with a triangular hole, in their rectangles."""
    r = src.rectangles(spark, d)
    side = F.col("lr_x") - F.col("ul_x")
    corner = lambda c: F.struct((F.col("ul_x") + side * c[0] / 8).alias("x"), (F.col("ul_y") - side * c[1] / 8).alias("y"))
    ring = lambda corners: F.array(*map(corner, [*corners, corners[0]]))
    return r.select(F.col("set_id").alias("zone"), F.array(ring(OUTER), ring(HOLE)).alias("rings"))


def zone_polygons(spark, d):
    """Statistics of the pixels whose centres each zone holds."""
    held = polygons.pixels_in(src.pixels(spark, d), zones(spark, d), ["zone"], src.AFFINE)
    return rounded(held.groupBy("zone").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean")), 4)


def zone_runs(spark, d):
    """Runs of pixels of each zone on the raster's own columns, and what they hold."""
    runs = polygons.filled_runs(zones(spark, d), ["zone"], src.AFFINE)
    return runs.groupBy("zone", "row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def points_in_holes(spark, d):
    """Pixel corners, a few of them on edges, in zones with a hole."""
    p = src.pixels(spark, d).select("id", (F.col("x") - 15).alias("x"), (F.col("y") + 15).alias("y"))
    return polygons.points_in(p, zones(spark, d), "zone").select("zone", "id")


def zone_tile_area(spark, d):
    """The area that each zone's outer ring shares with each tile."""
    outer = zones(spark, d).select("zone", F.slice("rings", 1, 1).alias("rings"))
    shared = polygons.shared_with_rects(outer, tiles(spark, d), "zone")
    return shared.select("zone", F.col("id").alias("tile_id"), F.round("area", 4).alias("area")).where("area > 0")


def united_area(spark, d):
    """What the rectangles of each nation cover together, each place once."""
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("nation"))
    r = src.rectangles(spark, d).join(s, "set_id")
    sides = r.groupBy("nation").agg(F.count("*").alias("n"), F.sum((F.col("lr_x") - F.col("ul_x")) * (F.col("ul_y") - F.col("lr_y"))).cast("bigint").alias("with_overlap"))
    area = polygons.united(r, "nation").groupBy("nation").agg(F.round(F.sum((F.col("lr_x") - F.col("ul_x")) * (F.col("ul_y") - F.col("lr_y")))).cast("bigint").alias("area"))
    return sides.join(area, "nation")


def picked_for_regions(spark, d):
    """Tiles picked for regions by the share of the area that their rectangles cover; a tile serves every region it meets, and none is nearer to another than 400 units."""
    s = src.table(spark, d, "supplier").join(F.broadcast(src.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are few
    r = src.rectangles(spark, d).join(s.select(F.col("s_suppkey").alias("set_id"), F.col("n_regionkey").alias("region")), "set_id")
    area = polygons.united(r, "region").groupBy("region").agg(F.sum((F.col("lr_x") - F.col("ul_x")) * (F.col("ul_y") - F.col("lr_y"))).alias("area"))
    quota = sampling.strata_quota(area, "area", 30).select("region", "quota")
    t = tiles(spark, d)
    serves = spatial.rect_pairs(t, r.withColumnRenamed("set_id", "id"), True).join(r.select(F.col("set_id").alias("right_id"), "region"), "right_id").select(F.col("left_id").alias("tile_id"), "region")
    places = t.select(F.col("id").alias("tile_id"), ((F.col("ul_x") + F.col("lr_x")) / 2).alias("x"), ((F.col("ul_y") + F.col("lr_y")) / 2).alias("y"))
    return sampling.picked_by_strata(places, serves, quota, "region", "tile_id", 400.0, 21).select("tile_id", "region")


#: What names a row of each part of an evaluation.
KEYS = {"histogram": ["bin_x", "bin_y"], "classes": ["cover"], "bins": ["bin"], "matrix": ["pred", "ref"], "zones_small": ["zone"], "zones_large": ["zone"]}


def evaluation_report(spark, d):
    """The whole evaluation of a map: two-dimensional histogram, classes, bins, matrix, and zones at two scales, as one long table."""
    small = zones(spark, d)
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("nation"))
    united = polygons.united(src.rectangles(spark, d).join(s, "set_id"), "nation")
    large = united.select(F.col("nation").alias("zone"), F.array(spatial.ring_of(*map(F.col, ("ul_x", "ul_y", "lr_x", "lr_y")))).alias("rings"))
    tables = evaluate.evaluate(covers(spark, d), EDGES_OF_BINS, {"small": small, "large": large.groupBy("zone").agg(F.flatten(F.collect_list("rings")).alias("rings"))}, src.AFFINE)
    return rounded(evaluate.melted(tables, KEYS), 3)


def _edges(corners) -> str:
    """Edges of a ring of the rectangle ``r`` as a list of (ax, ay, bx, by)."""
    at = lambda c: f"r.ul_x + (r.lr_x - r.ul_x) * {c[0]} / 8.0::DOUBLE, r.ul_y - (r.lr_x - r.ul_x) * {c[1]} / 8.0::DOUBLE"
    return " UNION ALL ".join(f"SELECT set_id AS zone, {at(a)}, {at(b)} FROM rect r" for a, b in zip(corners, [*corners[1:], corners[0]], strict=True))


EDGES = f"e(zone, ax, ay, bx, b_y) AS ({_edges(OUTER)} UNION ALL {_edges(HOLE)})"
RAYS = "((e.ay > {y}) <> (e.b_y > {y})) AND {x} < (e.bx - e.ax) * ({y} - e.ay) / (e.b_y - e.ay) + e.ax"


def _held(x: str, y: str) -> str:
    """Pairs of a zone and a pixel whose point is inside by the ray rule."""
    return f"held AS (SELECT e.zone, p.id FROM px p JOIN e ON {RAYS.format(x=x, y=y)} GROUP BY e.zone, p.id HAVING count(*) % 2 = 1)"


#: The area under an edge, both axes held within a tile: where the edge is inside the tile's columns, its height clamped to the tile's rows.
_CLAMPED = """c AS (SELECT o.zone, t.id AS tile_id, t.lr_y, t.ul_y, greatest(least(o.ax, o.bx), t.ul_x) AS x0, least(greatest(o.ax, o.bx), t.lr_x) AS x1, sign(o.bx - o.ax) AS s, (o.b_y - o.ay) / (o.bx - o.ax) AS m, o.ax, o.ay
        FROM o JOIN tiles t ON o.ax <> o.bx AND least(o.ax, o.bx) < t.lr_x AND greatest(o.ax, o.bx) > t.ul_x),
      k AS (SELECT *, ay + m * (x0 - ax) AS y0, ay + m * (x1 - ax) AS y1 FROM c WHERE x0 < x1),
      b AS (SELECT *, CASE WHEN m = 0 THEN x0 ELSE least(greatest((lr_y - ay) / m + ax, x0), x1) END AS u, CASE WHEN m = 0 THEN x0 ELSE least(greatest((ul_y - ay) / m + ax, x0), x1) END AS v FROM k),
      g AS (SELECT *, least(u, v) AS p, greatest(u, v) AS q FROM b),
      h AS (SELECT zone, tile_id, s * ((least(greatest(ay + m * ((x0 + p) / 2 - ax), lr_y), ul_y) - lr_y) * (p - x0) + (least(greatest(ay + m * ((p + q) / 2 - ax), lr_y), ul_y) - lr_y) * (q - p)
        + (least(greatest(ay + m * ((q + x1) / 2 - ax), lr_y), ul_y) - lr_y) * (x1 - q)) AS part FROM g)"""


def _melted(part: str, key: str, measures: list[str], query: str) -> str:
    """One part of the report from a query."""
    values = ", ".join(f"CAST({m} AS DOUBLE)" for m in measures)
    return f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, unnest({measures}) AS measure, round(unnest([{values}]), 3) AS value FROM ({query})"


_OVER = "count(*) AS n, avg(pred) AS pred_mean, avg(ref) AS ref_mean, avg(pred - ref) AS difference_mean, stddev_pop(pred - ref) AS difference_stdv"
_AC = ["ac", "ac_sys", "ac_unsys", "n"]
_CLASSES = agreement_sql("CAST(id % 5 AS INTEGER)", "WHERE id % 5 <> 0", 12, "cover").replace("SELECT cover, round", "SELECT cover, (SELECT 100 * sqrt(avg(pow((pred - ref) / CAST(nullif(ref, 0) AS DOUBLE), 2))) FROM pair z WHERE z.id % 5 = s.cover) AS rmspe, round")
_HISTOGRAM = sql("pair", body=""", e AS (SELECT min(ref) AS a, max(ref) AS b, min(pred) AS c, max(pred) AS d FROM pair),
  k AS (SELECT CAST(least(floor((ref - a) * 50 / CAST(b - a AS DOUBLE)), 49) AS INTEGER) AS bx, CAST(least(floor((pred - c) * 50 / CAST(d - c AS DOUBLE)), 49) AS INTEGER) AS b2 FROM pair, e) SELECT bx || '_' || b2 AS k, count(*) AS n FROM k GROUP BY ALL""")
_SMALL = sql("pair", "rect", body=f", {EDGES}, {_held('p.x', 'p.y')} SELECT zone, {_OVER} FROM held JOIN pair USING (id) GROUP BY zone")
_LARGE = sql("pair", "rect", body=f", held AS (SELECT DISTINCT s_nationkey AS zone, p.id FROM px p JOIN rect r ON p.x > r.ul_x AND p.x < r.lr_x AND p.y < r.ul_y AND p.y > r.lr_y JOIN supplier ON set_id = s_suppkey) SELECT zone, {_OVER} FROM held JOIN pair USING (id) GROUP BY zone")
_REPORT = " UNION ALL ".join(
    [
        _melted("histogram", "k", ["n"], _HISTOGRAM),
        _melted("classes", "cover", [*_AC, "rmspe"], _CLASSES),
        _melted("bins", "p", _AC, agreement_sql("p", "WHERE p = r", 12)),
        _melted("matrix", "pred || '_' || ref", ["n", "total_pxl", "pct_area", "n_pred", "adj"], sql("pair", body=f", {MATRIX} SELECT pred, ref, n, total_pxl, pct_area, n_pred, adj FROM m")),
        *[_melted(f"zones_{scale}", "zone", ["n", "pred_mean", "ref_mean", "difference_mean", "difference_stdv"], query) for scale, query in (("small", _SMALL), ("large", _LARGE))],
    ]
)

ALL = {
    "evaluation_report": (evaluation_report, _REPORT),
    "picked_for_regions": (picked_for_regions, None),
    "zone_polygons": (zone_polygons, sql("px", "rect", body=f""", {EDGES}, {_held('p.x', 'p.y')}
      SELECT zone, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean FROM held JOIN px USING (id) GROUP BY zone""")),
    "zone_runs": (zone_runs, sql("rect", body=f""", {EDGES}, box AS (SELECT zone, CAST(floor(min(ax) / 30) AS BIGINT) AS c0, CAST(ceil(max(ax) / 30) AS BIGINT) AS c1, CAST(floor(-max(ay) / 30) AS BIGINT) AS r0, CAST(ceil(-min(ay) / 30) AS BIGINT) AS r1 FROM e GROUP BY zone),
      cells AS (SELECT zone, "row", unnest(range(c0, c1 + 1)) AS col FROM (SELECT zone, c0, c1, unnest(range(r0, r1 + 1)) AS "row" FROM box)),
      held AS (SELECT c.zone, c."row", c.col FROM cells c JOIN e ON e.zone = c.zone AND {RAYS.format(x='(30 * c.col + 15)', y='(-30 * c."row" - 15)')} GROUP BY ALL HAVING count(*) % 2 = 1)
      SELECT zone, "row", count(*) AS n, min(col) AS first, max(col) AS last FROM held GROUP BY zone, "row" """)),
    "points_in_holes": (points_in_holes, sql("px", "rect", body=f", {EDGES}, {_held('(p.x - 15)', '(p.y + 15)')} SELECT zone, id FROM held")),
    "zone_tile_area": (zone_tile_area, sql("px", "rect", body=f", {TILES}, o(zone, ax, ay, bx, b_y) AS ({_edges(OUTER)}), {_CLAMPED} SELECT zone, tile_id, round(abs(sum(part)), 4) AS area FROM h GROUP BY ALL HAVING round(abs(sum(part)), 4) > 0")),
    "united_area": (united_area, sql("rect", body=f""", r AS (SELECT rect.*, s_nationkey AS nation FROM rect JOIN supplier ON set_id = s_suppkey),
      xs AS (SELECT nation, x AS x0, lead(x) OVER (PARTITION BY nation ORDER BY x) AS x1 FROM (SELECT nation, ul_x AS x FROM r UNION SELECT nation, lr_x FROM r)),
      ys AS (SELECT nation, y AS y0, lead(y) OVER (PARTITION BY nation ORDER BY y) AS y1 FROM (SELECT nation, ul_y AS y FROM r UNION SELECT nation, lr_y FROM r)),
      a AS (SELECT nation, sum((x1 - x0) * (y1 - y0)) AS area FROM xs JOIN ys USING (nation) WHERE EXISTS (SELECT 1 FROM r WHERE r.nation = xs.nation AND r.ul_x <= x0 AND x1 <= r.lr_x AND r.lr_y <= y0 AND y1 <= r.ul_y) GROUP BY nation)
      SELECT nation, n, CAST(with_overlap AS BIGINT) AS with_overlap, CAST(area AS BIGINT) AS area FROM (SELECT nation, count(*) AS n, sum((lr_x - ul_x) * (ul_y - lr_y)) AS with_overlap FROM r GROUP BY nation) JOIN a USING (nation)""")),
}
