"""Polygons, tiled and resumable rasters, resampling, projection, SQLite and prediction by combination against plain versions."""

import math
import random
import shutil
import sqlite3
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import projection, scalars
from parcelwise.operators import accuracy, evaluation, grid, polygons, predictors, sampling, spatial, trees
from parcelwise.sources import rasters
from parcelwise.sources import tables as src
from parcelwise.sources.sqlite import read_sqlite

RINGS = "id int, rings array<array<struct<x: double, y: double>>>"


def inside(x, y, rings):
    odd = 0
    for ring in rings or []:
        for (ax, ay), (bx, by) in zip(ring or [], (ring or [])[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd ^= 1
    return bool(odd)


def closed(*corners):
    return [*corners, corners[0]]


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    square = closed((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))
    hole = closed((2.0, 2.0), (5.0, 3.0), (4.0, 8.0))
    star = closed(*[(20 + (9 if k % 2 else 4) * math.cos(k * math.pi / 5), 5 + (9 if k % 2 else 4) * math.sin(k * math.pi / 5)) for k in range(10)])
    two = [closed((-8.0, -8.0), (-3.0, -8.0), (-3.0, -1.0)), closed((-12.0, 2.0), (-10.0, 9.0), (-14.0, 9.0))]
    thin = [closed((-20.0, 0.2), (30.0, 0.25), (30.0, 0.3))]
    random_ones = [[closed(*[(rng.uniform(-15, 30), rng.uniform(-10, 15)) for _ in range(rng.randint(3, 9))])] for _ in range(6)]
    return [[square, hole], [star], two, thin, [], None, [[]], [closed((1.0, 1.0))], [square, square], *random_ones]


def test_rings_that_are_not_closed_are_taken_to_be(spark, shapes):
    points = spark.range(400).select((F.col("id") % 20 - 5).cast("double").alias("x"), (F.floor(F.col("id") / 20) - 5).cast("double").alias("y"))
    told = lambda rings: sorted(map(tuple, polygons.points_in(points, spark.createDataFrame([(1, rings)], RINGS), "id").collect()))
    assert told([r[:-1] for r in shapes[0]]) == told(shapes[0]) != []
    area = spark.createDataFrame([(1, [shapes[0][0][:-1]])], RINGS).select(polygons.ring_area(F.col("rings")[0])).first()[0]
    assert area == 100.0


def table(spark, shapes):
    return spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], RINGS)


@pytest.mark.parametrize("affine", [(-16, 0.5, 0, 16, 0, -0.5), (-16, 0.5, 0, -12, 0, 0.5), (-16.3, 1, 0, 15.7, 0, -1)])
def test_filled_pixels_are_those_whose_centre_a_ray_finds_inside(spark, shapes, affine):
    n_rows, n_cols = (60, 100) if affine[1] == 0.5 else (30, 50)
    pixels = spark.range(n_rows * n_cols).select((F.col("id") / n_cols).cast("int").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"))
    got = {(r.id, r.row, r.col) for r in polygons.pixels_in(pixels, table(spark, shapes), ["id"], affine).collect()}
    centre = lambda r, c: (affine[0] + (c + 0.5) * affine[1], affine[3] + (r + 0.5) * affine[5])
    assert got == {(k, r, c) for k, s in enumerate(shapes) for r in range(n_rows) for c in range(n_cols) if inside(*centre(r, c), s)}


@pytest.mark.parametrize("size", [None, 1.7, 40.0])
def test_points_in_polygons_with_holes_and_on_edges(spark, shapes, size):
    rng = random.Random(5)
    points = [(k, rng.uniform(-22, 32), rng.uniform(-12, 16)) for k in range(1500)] + [(2000 + k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in range(-2, 12) for y in range(-2, 12))]
    got = sorted((r.id, r.point) for r in polygons.points_in(spark.createDataFrame(points, "point int, x double, y double"), table(spark, shapes), "id", size=size).collect())
    assert got == sorted((k, p) for p, x, y in points for k, s in enumerate(shapes) if inside(x, y, s))


def test_cells_away_from_borders_cast_no_rays(spark):
    big = spark.createDataFrame([(1, [closed((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))])], RINGS)
    cells = polygons.covering_cells(big, "id", 10.0)
    assert cells.where("NOT border").count() >= 64 and cells.where("border").count() <= 60


def test_clipped_rings_keep_the_area_within_a_window(spark):
    triangle, notched = closed((0.0, 0.0), (10.0, 0.0), (0.0, 10.0)), closed((0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 1.0), (0.0, 8.0))
    df = spark.createDataFrame([(1, [triangle]), (2, [notched])], RINGS)
    rects = spark.createDataFrame([(7, 2.0, 6.0, 6.0, 2.0), (8, -5.0, 20.0, 20.0, -5.0), (9, 50.0, 60.0, 60.0, 50.0)], "id int, ul_x double, ul_y double, lr_x double, lr_y double")
    zones = df.withColumnRenamed("id", "zone")
    got = {(r.zone, r.id): r.area for r in polygons.shared_with_rects(zones, rects, "zone").collect()}
    fine = lambda ring, x0, x1, y0, y1: sum(inside(x0 + (i + 0.5) * (x1 - x0) / 400, y0 + (j + 0.5) * (y1 - y0) / 400, [ring]) for i in range(400) for j in range(400)) * (x1 - x0) * (y1 - y0) / 160000
    assert set(got) == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert got[1, 8] == pytest.approx(50) and got[1, 7] == pytest.approx(14) and got[2, 7] == pytest.approx(fine(notched, 2, 6, 2, 6), abs=0.1)
    assert got[2, 8] == pytest.approx(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(notched, notched[1:], strict=False))) / 2)


def test_united_rectangles_count_each_place_once(spark):
    rng = random.Random(6)
    rects = [(k % 3, x, y + h, x + w, y) for k in range(60) for x, y, w, h in [(rng.randint(-20, 20), rng.randint(-20, 20), rng.randint(0, 12), rng.randint(1, 12))]] + [(0, 0, 5, 5, 0)] * 40
    df = spark.createDataFrame(rects, "part int, ul_x int, ul_y int, lr_x int, lr_y int")
    pieces = [tuple(r) for r in polygons.united(df, "part", 7.0).select("part", "ul_x", "ul_y", "lr_x", "lr_y").collect()]
    covered = {(p, x, y) for p, x0, y1, x1, y0 in rects for x in range(x0, x1) for y in range(y0, y1)}
    area = {p: sum((x1 - x0) * (y1 - y0) for q, x0, y1, x1, y0 in pieces if q == p) for p in range(3)}
    assert area == {p: sum(1 for c in covered if c[0] == p) for p in range(3)}
    for p, x0, y1, x1, y0 in pieces:
        assert not any(p == q and (x0, y0, x1, y1) != (a, d, c, b) and max(x0, a) < min(x1, c) and max(y0, d) < min(y1, b) for q, a, b, c, d in pieces)


def raster(spark, n_rows, n_cols):
    return spark.range(n_rows * n_cols).select((F.col("id") / n_cols).cast("int").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"), (F.col("id") * 7 % 101).cast("double").alias("value"))


def kernel(how, d):
    d = abs(d)
    return {"nearest": 1.0, "bilinear": 1 - d, "cubic": 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2}[how]


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("target", [(3, 20, 0, -5, 0, -20), (0, 30, 0, 0, 0, -30), (40, 75, 0, -200, 0, 75), (0, 60, 0, 0, 0, -60)])
def test_resampling_between_any_two_affines(spark, how, target):
    source, (n, m) = (0, 30, 0, 0, 0, -30), (13, 17)
    got = {(r.row, r.col): r.value for r in grid.resampled(raster(spark, n, m), source, target, 12, 14, how).collect()}
    taps, reach, _ = grid.KERNELS[how]
    want = {}
    for r in range(12):
        for c in range(14):
            v = (target[3] + target[5] * (r + 0.5) - source[3]) / source[5] - 0.5
            u = (target[0] + target[1] * (c + 0.5) - source[0]) / source[1] - 0.5
            rows, cols = (range(math.floor(p - reach) + 1, math.floor(p - reach) + 1 + taps) for p in (v, u))
            if rows[0] >= 0 and rows[-1] < n and cols[0] >= 0 and cols[-1] < m:
                want[r, c] = sum(((i * m + j) * 7 % 101) * kernel(how, i - v) * kernel(how, j - u) for i in rows for j in cols)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert grid.shift_between((90, 30, 0, -60, 0, -30), (0, 30, 0, 0, 0, -30)) == (2, 3)


def test_albers_round_trip_and_known_points(spark):
    rng = random.Random(7)
    points = [(rng.uniform(-170, -20), rng.uniform(5, 75)) for _ in range(300)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for cone in (projection.Albers(), projection.Albers(flattening=0.0), projection.Albers(first=-10, second=-40, latitude=-30, longitude=-60, x_0=1e6, y_0=5e5)):
        x, y = cone.forward(F.col("lon"), F.col("lat"))
        back = cone.inverse(F.col("x"), F.col("y"))
        for r in df.select("*", x.alias("x"), y.alias("y")).select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
            assert abs(r.lon - r.lon2) < 1e-7 and abs(r.lat - r.lat2) < 1e-7
    # published example: Clarke 1866, 29.5, 45.5, origin 23 N 96 W; 35 N 75 W
    clarke = projection.Albers(axis=6378206.4, flattening=1 - math.sqrt(1 - 0.00676866))
    r = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double").select(*clarke.forward(F.col("lon"), F.col("lat"))).first()
    assert abs(r[0] - 1885472.7) < 0.5 and abs(r[1] - 1535925.0) < 0.5


def files_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, len(df.inputFiles())


def test_windows_read_only_their_tiles(spark, tmp_path):
    path = str(tmp_path / "tiled")
    rasters.write_tiled(raster(spark, 60, 80), path, 20)
    window = rasters.read_window(spark, path, (15, 30), (45, 59), 20)
    plan = window._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "tile_row" in partition_filters and "tile_col" in partition_filters and "row" in plan[plan.index("PushedFilters") :]
    assert {(r.row, r.col) for r in window.collect()} == {(r, c) for r in range(15, 30) for c in range(45, 59)}
    assert sorted(window.select(F.input_file_name()).distinct().collect()).__len__() == 2 and len(spark.read.parquet(path).inputFiles()) == 12
    metrics = window._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    window.collect()
    assert "numFiles" in metrics.keySet().mkString(",")
    windows = spark.createDataFrame([(1, 0, 10, 0, 10), (2, 15, 25, 70, 99), (3, 5, 5, 0, 9), (4, 200, 210, 0, 9)], "w int, row_from int, row_to int, col_from int, col_to int")
    many = rasters.read_windows(spark, path, windows, 20)
    assert "dynamicpruning" in many._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.w, r.row, r.col) for r in many.collect()}
    assert got == {(1, r, c) for r in range(10) for c in range(10)} | {(2, r, c) for r in range(15, 25) for c in range(70, 80)}
    padded = rasters.read_padded(spark, path, (-2, 3), (78, 82), -1.0, 20)
    assert {(r.row, r.col): r.value for r in padded.collect()} == {(r, c): float((r * 80 + c) * 7 % 101) if 0 <= r and c < 80 else -1.0 for r in range(-2, 3) for c in range(78, 82)}
    assert rasters.read_padded(spark, path, (500, 502), (0, 2), -1.0, 20).where("value = -1").count() == 4


def test_lost_tiles_are_written_again_and_no_others(spark, tmp_path):
    path = str(tmp_path / "out")
    pixels = raster(spark, 20, 20).withColumn("tile_id", (F.floor(F.col("row") / 10) * 2 + F.floor(F.col("col") / 10)).cast("int"))
    wanted = spark.createDataFrame([(k,) for k in range(5)], "tile_id int")  # tile 4 has no pixels
    assert rasters.write_resumably(pixels, wanted, path) == 5 and rasters.write_resumably(pixels, wanted, path) == 0
    stamp = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    shutil.rmtree(f"{path}/tile_id=2")
    (halved,) = Path(f"{path}/tile_id=1").glob("*.parquet")
    pixels.where("tile_id = 1 AND row < 5").drop("tile_id").coalesce(1).write.mode("overwrite").parquet(f"{path}/tile_id=1")
    assert {r.tile_id for r in rasters.unfinished(spark, wanted, path).collect()} == {1, 2}
    assert rasters.write_resumably(pixels, wanted, path) == 2
    there = spark.read.parquet(path)
    assert there.count() == 400 and there.select("tile_id", "row", "col", "value").exceptAll(pixels.select("tile_id", "row", "col", "value")).isEmpty()
    kept = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert {p for p in stamp if kept.get(p) == stamp[p]} == {p for p in stamp if "tile_id=0" in str(p) or "tile_id=3" in str(p)}
    assert rasters.write_resumably(pixels, wanted, path) == 0


def test_a_mosaic_takes_the_last_layer_with_data(spark):
    layers = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, 9), (0, 1, 1, 5), (0, 1, 2, -1), (0, 2, 1, 70000), (0, 3, 1, None), (0, 4, 1, 3), (0, 4, 1, 4)], "row int, col int, layer int, value int")
    assert {(r.col, r.value) for r in rasters.mosaic(layers, "layer", "smallint", -1).collect()} == {(0, 9), (1, 5), (4, 4)}


def test_sqlite_tables_by_ranges_and_pushed_conditions(spark, tmp_path):
    path = str(tmp_path / "sets.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE support_sets (set_id INTEGER, "ul x" REAL, label TEXT, raw BLOB)')
        db.executemany("INSERT INTO support_sets VALUES (?, ?, ?, ?)", [(k, k / 2 if k % 7 else None, f"s{k % 5}", bytes([k % 256])) for k in range(1000)])
        db.execute("CREATE TABLE no_rows (a INTEGER)")
    df = read_sqlite(spark, path, "support_sets", 4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and dict(df.dtypes) == {"set_id": "bigint", "ul x": "double", "label": "string", "raw": "binary"}
    some = df.where("set_id >= 990 AND label IN ('s1', 's2') AND `ul x` IS NOT NULL")
    assert {r.set_id for r in some.collect()} == {k for k in range(990, 1000) if k % 5 in (1, 2) and k % 7}
    assert read_sqlite(spark, path, "no_rows").count() == 0
    sets = src.read_support_sets(spark, str(tmp_path), "set_id int, label string")
    assert sets.count() == 1000 and dict(sets.dtypes)["set_id"] == "int"


def test_hashes_of_all_whole_numbers(spark):
    keys = [0, 1, 2**31, 2**32 - 1, 4 * 10**9, 2**33 + 5, 2**62, 2**63 - 1, -1, -(2**63)]

    def plain(key, seed):
        low, high = key % 2**32, (key % 2**64) >> 32
        once = (low * 2654435761 + high * 2246822519 + seed * 40503) % 2**32
        return (once * 1597334677 + 12345) % 2**32

    df = spark.createDataFrame([(k,) for k in keys], "id long")
    assert [r[0] for r in df.select(scalars.portable_hash(F.col("id"), 5)).collect()] == [plain(k, 5) for k in keys]


def test_predictors_beyond_their_type_are_nodata_or_held_by_a_wider_one(spark):
    pixels = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "row int, col int")
    values = {"a": (spark.createDataFrame([(0, 0, 40000), (0, 1, 7)], "row int, col int, value int"), None)}
    got = lambda **k: [r.a for r in predictors.of_tile(pixels, values, -9999, **k).orderBy("col").collect()]
    assert got() == [-9999, 7, -9999] and got(kind="int") == [40000, 7, -9999]


def test_prediction_by_combination_equals_prediction_by_set(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.random((400, 2))
    pixels = spark.createDataFrame([(k, float(a), None if k % 50 == 0 else float(b), float(10 * a + b)) for k, (a, b) in enumerate(x)], "id long, a double, b double, y double")
    pairs = spark.createDataFrame([(k, s) for k in range(400) for s in range(5) if (k // 40 + s) % 3 or k < 30 * s], "id long, set_id long")
    members = pairs.join(pixels, "id").withColumn("in_bag", F.col("id") % 3 > 0)
    nodes = trees.train_sets(members, "y", ["a", "b"], least_rows=185)
    assert 0 < nodes.select("set_id").distinct().count() < 5
    monkeypatch.setattr(trees, "COMBINATION_PIXELS", 30)
    want = {r.id: r.p for r in trees.predict(members, nodes, ["a", "b"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("set_id", "prediction"))).alias("p")).collect()}
    got = {r.id: r.predictions for r in trees.predict_by_combination(pixels, pairs, nodes, ["a", "b"]).collect()}
    assert got == {k: [x.prediction for x in p] for k, p in want.items()}


@pytest.mark.parametrize("distance", [4.0, 15.0])
def test_picks_for_shared_places_are_those_of_the_plain_loop(spark, distance):
    rng = random.Random(14)
    places = [(k, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for k in range(250)]
    serves = [(k, s) for k, _, _ in places for s in "abcde" if rng.random() < 0.4] + [(999, "a"), (3, "a"), (3, "a")]
    quota = {"a": 5, "b": 12, "c": 1, "d": 200, "e": 0, "nowhere": 3}
    df = spark.createDataFrame(places, "id long, x double, y double")
    got = sampling.picked_by_strata(df, spark.createDataFrame(serves, "id long, s string"), spark.createDataFrame(list(quota.items()), "s string, quota int"), "s", "id", distance, 9)
    order = spark.createDataFrame(sorted(set(serves)), "id long, s string").select("id", "s", scalars.portable_hash(F.crc32(F.col("s").cast("binary")), 9).alias("a"), scalars.portable_hash(F.col("id"), 9).alias("b"))
    at, n, want = {k: (x, y) for k, x, y in places}, dict.fromkeys(quota, 0), []
    for r in sorted(order.collect(), key=lambda r: (r.a, r.s, r.b, r.id)):
        if r.id in at and n[r.s] < quota[r.s] and all(math.dist(at[r.id], at[k]) > distance for k, _ in want):
            want.append((r.id, r.s))
            n[r.s] += 1
    assert sorted((r.id, r.s) for r in got.collect()) == sorted(want) and n["b"] > 0


def test_bins_by_number_and_samples_matched_with_their_surroundings(spark):
    rows = spark.createDataFrame([(r, c, (r * 7 + c * 3) % 20, (r * 5 + c) % 23, (r + c) % 2 == 0) for r in range(6) for c in range(6) if (r, c) != (2, 2)], "row int, col int, pred int, ref int, sampled boolean")
    assert accuracy.equal_edges(rows, "ref", 4) == [(-1, 0), (0, 5), (5, 10), (10, 15), (15, 20), (20, 25)]
    with pytest.raises(ValueError):
        accuracy.equal_edges(rows, "ref", 50)
    held = {(r.row, r.col): r for r in rows.collect()}
    around = lambda k: [held[k[0] + i, k[1] + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k[0] + i, k[1] + j) in held]
    for best in (True, False):
        for r in accuracy.with_matches(rows, "pred", "ref", "sampled", best).collect():
            near = around((r.row, r.col))
            want = (None, None) if not r.sampled else (r.pred, min(near, key=lambda n: abs(n.ref - r.pred)).ref) if best else (sum(n.pred for n in near) // len(near), sum(n.ref for n in near) // len(near))
            assert (r.sample_pred, r.sample_ref) == want


def test_a_whole_evaluation_leaves_out_what_has_no_data(spark, tmp_path):
    rows = [(r, c, (r * 3 + c) % 11 if (r, c) != (1, 1) else -1, (r * 2 + c) % 11 if (r, c) != (2, 2) else None, (r + c) % 3, c % 2 == 0) for r in range(8) for c in range(8)]
    pixels = spark.createDataFrame(rows, "row int, col int, pred int, ref int, cover int, sampled boolean")
    zone = spark.createDataFrame([(4, [closed((0.0, 0.0), (90.0, 0.0), (90.0, -90.0), (0.0, -90.0))])], RINGS).withColumnRenamed("id", "zone")
    found = evaluation.evaluate(pixels, [(-1, 5), (5, 11)], {"near": zone}, src.AFFINE, masked=F.col("row") == 7, nodata=(-1, None), bins=5)
    held = [r for r in rows if r[:2] not in ((1, 1), (2, 2)) and r[0] < 7]
    assert sorted((r.row, r.col, r.difference) for r in found["difference"].collect()) == sorted((r[0], r[1], r[2] - r[3]) for r in held)
    assert found["histogram"].agg(F.sum("n")).first()[0] == len(held) and {r.cover for r in found["classes"].collect()} == {1, 2}
    inner = [r for r in held if r[0] < 3 and r[1] < 3]
    (z,) = found["zones_near"].collect()
    assert (z.zone, z.n) == (4, len(inner)) and z.difference_mean == pytest.approx(sum(r[2] - r[3] for r in inner) / len(inner))
    evaluation.write_evaluation(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "difference")).count() == len(held) and spark.read.csv(str(tmp_path / "out" / "zones_near"), sep="\t", header=True).count() == 1


def test_rectangles_of_very_mixed_extents_meet_on_levels_of_cells(spark):
    rng = random.Random(15)
    rects = [(k, x, y + h, x + w, y) for k in range(160) for s in [rng.choice([1, 1, 1, 30, 900, 20_000])] for x, y, w, h in [(rng.randint(-20_000, 20_000), rng.randint(-20_000, 20_000), rng.randint(0, 2 * s), rng.randint(0, 2 * s))]]
    rects += [(200 + k, 3 * k, 3, 3 * k + 3, 0) for k in range(20)]
    df = spark.createDataFrame(rects, "id int, ul_x int, ul_y int, lr_x int, lr_y int")
    assert len(spatial.cell_sizes(df)) > 2
    shared = lambda a, b: (min(a[3], b[3]) - max(a[1], b[1]), min(a[2], b[2]) - max(a[4], b[4]))
    for touching in (True, False):
        want = sorted((a[0], b[0], w * h) for a in rects for b in rects for w, h in [shared(a, b)] if (min(w, h) >= 0 if touching else min(w, h) > 0))
        assert sorted(map(tuple, spatial.rect_pairs(df, df, touching).collect())) == want
    points = [(rng.choice([r[1] for r in rects]) + rng.randint(-2, 2), rng.choice([r[2] for r in rects]) + rng.randint(-2, 2)) for _ in range(400)] + [(r[1], r[2]) for r in rects]
    held = spatial.points_in_rects(spark.createDataFrame(points, "x int, y int"), df, "half_open")
    assert sorted((r.x, r.y, r.id) for r in held.collect()) == sorted((x, y, r[0]) for x, y in points for r in rects if r[1] <= x < r[3] and r[4] < y <= r[2])


def test_manifests_name_the_commit_that_made_an_output(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-m", "first")
    assert src.last_commit(str(tmp_path)) == git("rev-parse", "HEAD") and src.last_commit(str(tmp_path / "nowhere")) == ""


def test_nodata_counts_nowhere_but_keeps_its_class(spark):
    pairs = [("a", 1, 1)] * 3 + [("a", 1, 2), ("a", 0, 1), ("a", 2, 0), ("a", 2, 2), ("b", 0, 5), ("b", 5, 0), (None, 3, 3), (None, 3, 4)]
    df = spark.createDataFrame(pairs, "g string, p int, r int")
    got = {(r.g, r["class"]): tuple(r)[2:] for r in accuracy.plain_without(df, "p", "r", 0, ["g"]).collect()}
    assert got["a", 1] == (4, 3, 3, 0.25, 0.0, 0.8) and got["a", 2] == (1, 2, 1, 0.0, 0.5, 0.8) and got["a", 0] == (0, 0, 0, None, None, 0.8)
    assert got["b", 5] == (0, 0, 0, None, None, None) and got[None, 4] == (0, 1, 0, None, 1.0, 0.5) and len(got) == 7


def test_rows_side_by_side(spark):
    left, right = spark.createDataFrame([(9,), (4,), (7,)], "a int"), spark.createDataFrame([("x",), ("b",)], "s string")
    assert [tuple(r) for r in accuracy.side_by_side(left, right, "a", "s").orderBy("place").collect()] == [(0, 4, "b"), (1, 7, "x"), (2, 9, None)]
