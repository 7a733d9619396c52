"""Queries on containment, overlap, adjacency, nearest and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import four_digits, portable_hash
from ..operators import spatial
from ..sources import tables as src

sql = src.sql


def obs_in_rect(spark, d):
    return spatial.points_in_rects(src.pixels(spark, d), src.rectangles(spark, d), "strict").groupBy("set_id").agg(F.count("*").alias("n_obs"), F.sum("id").alias("sum_id"))


def pixel_sets(spark, d):
    p = src.pixels(spark, d).select("id", (F.col("x") - 15).alias("x"), (F.col("y") + 15).alias("y"))
    found = spatial.points_in_rects(p, src.rectangles(spark, d), "half_open").groupBy("id").agg(F.array_sort(F.collect_list("set_id")).alias("s"))
    return found.select("id", F.concat_ws("_", F.transform("s", lambda x: x.cast("string"))).alias("sets"), F.size("s").cast("bigint").alias("n_sets"))


def rects(spark, d):
    return src.rectangles(spark, d).withColumnRenamed("set_id", "id")


def rect_overlap(spark, d):
    return spatial.rect_pairs(rects(spark, d), rects(spark, d), False).where("left_id < right_id")


def rect_intersects_semi(spark, d):
    r = rects(spark, d)
    hit = spatial.rect_pairs(r, r.where("ul_x >= 2400"), True)
    return r.join(hit, r.id == hit.left_id, "left_semi").select("id")


def tiles(spark, d):
    p = src.pixels(spark, d)
    return p.groupBy(F.col("tile_id").alias("id")).agg(F.min(F.col("x") - 15).cast("bigint").alias("ul_x"), F.max(F.col("y") + 15).cast("bigint").alias("ul_y"), F.max(F.col("x") + 15).cast("bigint").alias("lr_x"), F.min(F.col("y") - 15).cast("bigint").alias("lr_y"))


def empty_tiles(spark, d):
    hit = spatial.rect_pairs(tiles(spark, d), rects(spark, d), False).select(F.col("left_id").alias("id"))
    return tiles(spark, d).join(hit, "id", "left_anti").select("id")


def proportional_area(spark, d):
    pairs = spatial.rect_pairs(tiles(spark, d), rects(spark, d), False)
    return pairs.select(F.col("left_id").alias("tile_id"), F.col("right_id").alias("set_id"), F.round(F.col("area") / 90000, 6).alias("share"))


def assign_processing_tile(spark, d):
    pairs = spatial.rect_pairs(rects(spark, d), tiles(spark, d), False)
    return pairs.groupBy(F.col("left_id").alias("set_id")).agg(F.max("right_id").alias("tile_id"))


def halved_tiles(spark, d):
    """Tiles without every third one, so that those left touch in several regions."""
    return tiles(spark, d).where("id % 3 <> 1")


def touching_components(spark, d):
    return spatial.touching_components(halved_tiles(spark, d))


def point_in_ring(spark, d):
    """Pixel centres in a five-cornered ring."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(300, -100), corner(2400, -250), corner(2000, -1500), corner(1200, -700), corner(500, -1300), corner(300, -100))
    p = src.pixels(spark, d)
    return p.where(spatial.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), ring)).select("id")


def nearest_edge_snap(spark, d):
    r = src.rectangles(spark, d)
    edges = r.select(F.col("ul_x").alias("edge")).union(r.select(F.col("lr_x").alias("edge"))).distinct()
    return spatial.nearest(src.pixels(spark, d).select("id", F.col("x").cast("bigint").alias("x")), edges, "x", "edge").select("id", "x", F.col("nearest").alias("edge"))


def sample_rasters(spark, d):
    p = src.pixels(spark, d)
    s = p.where(portable_hash(F.col("id"), 3) < 429496729).select("row", "col")
    other = p.groupBy("row", "col").agg(F.max("value").alias("value"), F.max("tile_id").alias("tile_id"))
    return s.join(other, ["row", "col"])


def zone_of_pixel(spark, d):
    c, n = src.table(spark, d, "customer"), src.table(spark, d, "nation")
    zones = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("custkey"), F.col("n_regionkey").alias("zone"))
    return src.pixels(spark, d).join(zones, "custkey").groupBy("zone").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))


def train_pixel_anti(spark, d):
    p = src.pixels(spark, d)
    train = p.where(portable_hash(F.col("id"), 1) < 2147483648).select("row", "col")
    return p.join(train, ["row", "col"], "left_anti").select("id")


def psu_split(spark, d):
    """Pixels of chosen tiles as a test table; the same pixels blank in the training raster."""
    p = src.pixels(spark, d)
    return p.select("id", F.when(F.col("tile_id") % 7 == 0, F.col("value")).alias("test"), F.when(F.col("tile_id") % 7 != 0, F.col("value")).alias("train"))


def name_like_join(spark, d):
    files = src.table(spark, d, "customer").select(F.concat(F.lit("dem_"), four_digits(F.col("c_custkey")), F.lit(".img")).alias("file"))
    ids = src.table(spark, d, "supplier").select("s_suppkey", four_digits(F.col("s_suppkey")).alias("tile"))
    return spatial.names_holding(files, ids, "file", "tile", 4).select("file", "s_suppkey")


def mask_pair(spark, d):
    p = src.pairs_in_order(spark, d)
    ok = F.col("status") != "P"
    return p.select("id", F.when(ok, F.col("ref")).alias("ref"), F.when(ok & (F.col("pred") > 20), F.col("pred")).alias("pred")).where("ref IS NOT NULL AND pred IS NOT NULL")


INSIDE = "p.x > r.ul_x AND p.x < r.lr_x AND p.y > r.lr_y AND p.y < r.ul_y"
TILES = "tiles AS (SELECT tile_id AS id, CAST(min(x - 15) AS BIGINT) AS ul_x, CAST(max(y + 15) AS BIGINT) AS ul_y, CAST(max(x + 15) AS BIGINT) AS lr_x, CAST(min(y - 15) AS BIGINT) AS lr_y FROM px GROUP BY tile_id)"
SHARED = "a.ul_x < b.lr_x AND b.ul_x < a.lr_x AND a.lr_y < b.ul_y AND b.lr_y < a.ul_y"
AREA = "(least(a.lr_x, b.lr_x) - greatest(a.ul_x, b.ul_x)) * (least(a.ul_y, b.ul_y) - greatest(a.lr_y, b.lr_y))"
TOUCH = "a.ul_x <= b.lr_x AND b.ul_x <= a.lr_x AND a.lr_y <= b.ul_y AND b.lr_y <= a.ul_y"
HASH = "((((id * 2654435761 + {s} * 40503) % 4294967296) * 1597334677 + 12345) % 4294967296)"
RING = [(300, -100, 2400, -250), (2400, -250, 2000, -1500), (2000, -1500, 1200, -700), (1200, -700, 500, -1300), (500, -1300, 300, -100)]

ALL = {
    "obs_in_rect_strict": (obs_in_rect, sql("px", "rect", body=f"SELECT r.set_id, count(*) AS n_obs, CAST(sum(p.id) AS BIGINT) AS sum_id FROM px p JOIN rect r ON {INSIDE} GROUP BY r.set_id")),
    "pixel_sets_halfopen": (pixel_sets, sql("px", "rect", body="""SELECT p.id, string_agg(CAST(r.set_id AS VARCHAR), '_' ORDER BY r.set_id) AS sets, count(*) AS n_sets
      FROM px p JOIN rect r ON p.x - 15 >= r.ul_x AND p.x - 15 < r.lr_x AND p.y + 15 > r.lr_y AND p.y + 15 <= r.ul_y GROUP BY p.id""")),
    "rect_overlap": (rect_overlap, sql("rect", body=f"SELECT a.set_id AS left_id, b.set_id AS right_id, {AREA} AS area FROM rect a JOIN rect b ON a.set_id < b.set_id AND {SHARED}")),
    "rect_intersects_semi": (rect_intersects_semi, sql("rect", body=f"SELECT a.set_id AS id FROM rect a WHERE EXISTS (SELECT 1 FROM rect b WHERE b.ul_x >= 2400 AND {TOUCH})")),
    "empty_tiles_anti": (empty_tiles, sql("px", "rect", body=f", {TILES} SELECT a.id FROM tiles a WHERE NOT EXISTS (SELECT 1 FROM rect b WHERE {SHARED})")),
    "proportional_area": (proportional_area, sql("px", "rect", body=f", {TILES} SELECT a.id AS tile_id, b.set_id, round({AREA} / 90000, 6) AS share FROM tiles a JOIN rect b ON {SHARED}")),
    "assign_processing_tile": (assign_processing_tile, sql("px", "rect", body=f", {TILES} SELECT b.set_id, max(a.id) AS tile_id FROM tiles a JOIN rect b ON {SHARED} GROUP BY b.set_id")),
    "touching_components": (touching_components, sql("px", body=f""", {TILES}, s AS (SELECT * FROM tiles WHERE id % 3 <> 1),
      e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id <> b.id AND {TOUCH} AND NOT ({SHARED})),
      r AS (SELECT id, id AS reached FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached) SELECT id, min(reached) AS region_id FROM r GROUP BY id""").replace("WITH px", "WITH RECURSIVE px")),
    "point_in_ring": (point_in_ring, sql("px", body="SELECT id FROM px WHERE (" + " + ".join(f"CASE WHEN (({b} > y) <> ({e} > y)) AND x < ({c} - {a}) * (y - ({b})) / CAST({e} - ({b}) AS DOUBLE) + {a} THEN 1 ELSE 0 END" for a, b, c, e in RING) + ") % 2 = 1")),
    "nearest_edge_snap": (nearest_edge_snap, sql("px", "rect", body=""", e AS (SELECT ul_x AS edge FROM rect UNION SELECT lr_x FROM rect), v AS (SELECT DISTINCT CAST(x AS BIGINT) AS x FROM px),
      n AS (SELECT x, arg_min(edge, (abs(edge - x), edge)) AS edge FROM v CROSS JOIN e GROUP BY x) SELECT p.id, CAST(p.x AS BIGINT) AS x, n.edge FROM px p JOIN n ON n.x = p.x""")),
    "sample_rasters": (sample_rasters, sql("px", body=f'SELECT "row", col, value, tile_id FROM px WHERE {HASH.format(s=3)} < 429496729')),
    "zone_of_pixel": (zone_of_pixel, sql("px", body="SELECT n_regionkey AS zone, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM px JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")),
    "train_pixel_anti": (train_pixel_anti, sql("px", body=f"SELECT id FROM px WHERE NOT {HASH.format(s=1)} < 2147483648")),
    "psu_split": (psu_split, sql("px", body="SELECT id, CASE WHEN tile_id % 7 = 0 THEN value END AS test, CASE WHEN tile_id % 7 <> 0 THEN value END AS train FROM px")),
    "name_like_join": (name_like_join, """WITH f AS (SELECT 'dem_' || right('0000' || c_custkey, 4) || '.img' AS file FROM customer), i AS (SELECT s_suppkey, right('0000' || s_suppkey, 4) AS tile FROM supplier)
      SELECT file, s_suppkey FROM f JOIN i ON file LIKE '%' || tile || '%'"""),
    "mask_pair": (mask_pair, sql("pair", body="SELECT id, ref, pred FROM pair WHERE status <> 'P' AND pred > 20")),
}
