"""Faults met on larger tables, each on a few made rows."""

import itertools
import shutil
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import projection
from parcelwise.llm import simhash
from parcelwise.operators import forests, polygons, sampling, spatial, trees
from parcelwise.plans import catalogue, ensembles, grids, values
from parcelwise.sources import rasters, tables

SMOKE = "/root/testdata/sf0.001"


def test_a_split_between_neighbouring_doubles_leaves_no_side_empty(spark):
    low = 0.03
    high = float(np.nextafter(low, 1))
    if (low + high) / 2 == low:  # take the pair whose middle is rounded up
        low, high = high, float(np.nextafter(high, 1))
    assert (low + high) / 2 == high
    x, y = np.array([[low]] * 3 + [[high]] * 3), np.array([1.0, 1, 1, 5, 5, 5])
    nodes = trees.fit_tree(x, y, ["a"], 3)
    assert [n[5] for n in nodes] == [3.0, 1.0, 5.0] and nodes[0][2] == low
    rows = [(k, 1, float(v[0]), float(t), True) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    members = spark.createDataFrame(rows, "id long, set_id long, a double, y double, in_bag boolean")
    trained = trees.train_sets(members, "y", ["a"], least_rows=2)
    got = trees.predict_by_combination(members.select("id", "a"), members.select("id", "set_id"), trained, ["a"])
    assert {r.id: r.predictions for r in got.collect()} == {k: [t] for k, t in enumerate(y)}


def test_pairs_are_split_on_rows_of_any_number(spark):
    rows = spark.createDataFrame([(k % 3 * 40_000 + k, k % 7) for k in range(60)], "row int, col int")
    out = sampling.split_by_pairs(rows, ["row", "col"], 0.5, 9)
    assert out.where(F.col("train")).count() == 30


def test_degrees_of_a_raster_beyond_the_poles_come_back(spark, tmp_path):
    keys = [0, 93_250, 93_300, 213_300, 333_399, 8_999_999]
    made = spark.createDataFrame([(k, 1, 1.0, "O", "1") for k in keys], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string")
    made.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.id: (r.longitude, r.latitude) for r in grids.albers_inverse(spark, str(tmp_path)).collect()}
    assert got == {k: (pytest.approx(-125 + (30 * (k % 100) + 15) / 100), pytest.approx(50 - (30 * (k // 100) + 15) / 200)) for k in keys}
    turns = spark.createDataFrame([(v,) for v in (-90.0, 0.0, 89.9, 90.0, -90.025)], "v double").select(projection.half_turns(F.col("v")).alias("n")).collect()
    assert [r.n for r in turns] == [0, 0, 0, 1, -1]


def test_points_in_polygons_send_no_cells_through_the_driver(spark):
    ring = "array(array(struct({0} AS x, 0D AS y), struct({0} + 5D AS x, 0D AS y), struct({0} + 5D AS x, 5D AS y), struct({0} AS x, 5D AS y)))"
    shapes = spark.range(3).selectExpr("id AS zone", ring.format("id * 10D") + " AS rings")
    points = spark.range(300).selectExpr("id", "id / 10D AS x", "2D AS y")
    held = polygons.points_in(points, shapes, "zone")
    assert held.count() == 150
    assert "BroadcastHashJoin" not in held._jdf.queryExecution().executedPlan().toString()


def test_predictions_on_a_whole_number_do_not_hang_on_the_order_of_lines(spark, tmp_path):
    prices = [23406.48, 62224.02, 15169.5]  # 33600 on average, less by one bit in some orders
    orders = [(p, k) for k, p in enumerate(itertools.permutations(prices))]
    lines = [(k, 1, 1.0, v, 0.0, 0.0, "N") for p, k in orders for v in p]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 1, 1.0, "O", "1") for _, k in orders], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r.pred for r in tables.pairs(spark, str(tmp_path)).collect()} == {32}


def test_runs_meet_their_first_name_before_they_meet_ids(spark):
    names = spark.createDataFrame([("b_0012",), ("a_0012",), ("c_0099",), ("x",)], "file string")
    ids = spark.createDataFrame([(12, "0012"), (10012, "0012"), (7, "0007")], "k long, tile string")
    out = spatial.first_name_holding(names, ids, "file", "tile", 4)
    assert {(r.k, r.file) for r in out.collect()} == {(12, "a_0012"), (10012, "a_0012")}


def test_the_nearest_coordinate_is_found_without_a_frame_read_anew_for_each_row(spark):
    values = spark.range(0, 60).selectExpr("id AS v")
    edges = spark.createDataFrame([(k,) for k in (3, 10, 11, 40, 40)], "edge long")
    out = spatial.nearest(values, edges, "v", "edge")
    assert {r.v: r.nearest for r in out.collect()} == {v: min((3, 10, 11, 40), key=lambda e: (abs(v - e), e)) for v in range(60)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert all("part#" in line.split("windowspecdefinition(")[1].split(",")[0] and "currentrow$(), unboundedfollowing$()" not in line for line in plan.lower().splitlines() if "windowspecdefinition(part#" in line)


def test_trials_draw_the_same_rows_as_a_sample_of_repeated_rows(spark):
    rows = spark.range(0, 5000).selectExpr("id * 1000003 AS id", "CAST(id % 7 AS INT) AS tile", "CAST(id % 90 AS INT) AS v").repartition(5)
    got = sampling.repeated_quota(rows, "tile", "id", 2, 6, 12)
    repeated = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("key", F.col("id") * 6 + F.col("trial"))
    want = sampling.quota_sample(repeated, ["trial", "tile"], "key", F.lit(2), 12)
    assert {(r.trial, r.tile, r.id, r.v) for r in got.collect()} == {(r.trial, r.tile, r.id, r.v) for r in want.collect()} and got.count() == 84


def test_importances_are_averaged_before_rows_are_repeated_by_variable(spark):
    plan = ensembles.importance_map(spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(k for k, line in enumerate(plan) if "Expand" in line) < next(k for k, line in enumerate(plan) if "Join" in line) and sum("Expand" in line for line in plan) == 1
    assert "Aggregate" in "".join(plan[: next(k for k, line in enumerate(plan) if "Join" in line)]).split("Expand")[1]


def test_labels_come_from_one_pass_over_the_pairs(spark):
    plan = values.label_union(spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_errors_by_the_number_of_trees_leave_out_nulls(spark):
    rows = spark.createDataFrame([(1, [2.0, None, 4.0]), (5, [None, 5.0, 8.0])], "ref int, predictions array<double>")
    got = {r.n_trees: (r.rmse, r.n) for r in forests.error_by_trees(rows, "ref", 3).collect()}
    assert got == {1: (1.0, 1), 2: (pytest.approx(0.5**0.5), 2), 3: (pytest.approx(((2**2 + 1.5**2) / 2) ** 0.5), 2)}


def test_few_combinations_of_bins_take_one_pass_and_give_the_same_forest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, float(a), float(b), float(a * b > 9) * (k % 5)) for k, (a, b) in enumerate(rng.integers(0, 7, (500, 2)))], "id long, a double, b double, y double")
    kept = []
    monkeypatch.setattr(forests, "cut", lambda df: kept.append(df) or df)
    once = [m.collect() for m in forests.grow_zero_inflated(rows, "y", ["a", "b"], 3, max_features=1)]
    assert not kept
    monkeypatch.setattr(forests, "FEW_CELLS", 0)
    models = forests.grow_zero_inflated(rows, "y", ["a", "b"], 3, max_features=1)
    assert kept and [m.collect() for m in models] == once
    each = {r.id: r.predictions for r in forests.predict_zero_inflated(rows, models, ["a", "b"]).collect()}
    mean = {r.id: r.prediction for r in forests.predict_zero_inflated(rows, models, ["a", "b"], mean=True).collect()}
    assert mean == {k: sum(v) / 3 for k, v in each.items()} and len(set(mean.values())) > 2


def test_sets_are_fitted_and_predicted_where_their_members_meet(spark):
    rng = np.random.default_rng(6)
    n = 600
    x, sets = rng.integers(0, 9, (n, 2)).astype(float), rng.integers(0, 5, n) * 40
    rows = [(k, int(s), bool(rng.random() < 0.6), None if k % 50 == 1 else float(a), float(b), None if k % 60 == 2 else float((a > 4) * (b + k % 3))) for k, (s, (a, b)) in enumerate(zip(sets, x, strict=True))]
    m = spark.createDataFrame(rows + [(n + k, 7, True, None, 1.0, 2.0) for k in range(30)] + [(n + 30, 9, True, 1.0, 1.0, 2.0)], "id long, set_id long, in_bag boolean, a double, b double, y double").coalesce(1)
    nodes = trees.train_sets(m, "y", ["b", "a"])
    plain = {(r.id, r.set_id): r.prediction for r in trees.predict(m, nodes, ["b", "a"]).collect()}
    own = trees.predict_own(m, "y", ["b", "a"])
    assert {(r.id, r.set_id): r.prediction for r in own.collect()} == plain and len(plain) == n
    joined = trees.oob_metrics(trees.predict(m.where("NOT in_bag"), nodes, ["b", "a"]), m, "y")
    held = trees.predict_own(m, "y", ["b", "a"], kept=(), which="held")
    assert sorted(trees.oob_fit(held).collect()) == sorted(joined.collect())
    assert trees.predict_own(m, "y", ["b", "a"], which="complete").count() == sum(r[3] is not None for r in rows)
    assert "Join" not in own._jdf.queryExecution().toString()
    said = {r.set_id: r for r in trees.summaries_of_sets(m, "y", ["b", "a"]).collect()}
    assert {s: (r.n, r.problem) for s, r in said.items() if r.problem} == {r.set_id: (r.n_rows, r.problem) for r in trees.refused(m, nodes, "y", ["b", "a"]).collect()} and len(said) == 7
    assert all(r["mean"] == pytest.approx(np.mean([v for (_, s), v in plain.items() if s == t])) for t, r in said.items() if not r.problem)
    mixed = trees.predict_zero_inflated(m, trees.zero_inflated(m, "y", ["b", "a"]), ["b", "a"])
    assert sorted(trees.zero_inflated_own(m, "y", ["b", "a"]).collect()) == sorted(mixed.collect())
    c = m.withColumn("c", F.floor("y").cast("int"))
    classes = trees.class_importance(c, trees.train_sets(c, "c", ["b", "a"], classes=True), "c", ["b", "a"])
    assert sorted(trees.class_importance_own(c, "c", ["b", "a"]).collect()) == sorted(classes.collect())


def test_small_tiles_share_folders_and_are_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "out")
    pixels = spark.range(1200).select((F.col("id") % 12 + F.floor(F.col("id") % 12 / 6) * 2).cast("int").alias("tile_id"), "id", (F.col("id") * 7 % 101).alias("value"))
    wanted = pixels.select("tile_id").distinct().unionByName(spark.createDataFrame([(6,)], "tile_id int"))  # tile 6 has no pixels
    assert rasters.write_resumably(pixels, wanted.where("tile_id % 3 <> 0"), path, 5) == 8
    assert rasters.write_resumably(pixels, wanted, path, 5) == 5 and rasters.write_resumably(pixels, wanted, path, 5) == 0
    files = sorted(Path(path).rglob("*.parquet"))
    assert len(files) == 3 and sorted(p.parent.name for p in files) == ["tile_block=0", "tile_block=1", "tile_block=2"]
    stamp = {p: p.stat().st_mtime_ns for p in files}
    # a folder is lost, and another has lost half of a tile
    shutil.rmtree(f"{path}/tile_block=1")
    spark.read.parquet(f"{path}/tile_block=0").where("tile_id <> 2 OR id < 600").write.parquet(str(tmp_path / "half"))
    shutil.rmtree(f"{path}/tile_block=0")
    shutil.copytree(tmp_path / "half", f"{path}/tile_block=0")
    assert rasters.write_resumably(pixels, wanted, path, 5) == 1 + 3
    there = spark.read.parquet(path).select("tile_id", "id", "value")
    assert there.count() == 1200 and there.exceptAll(pixels).isEmpty()
    assert {p for p in stamp if p.exists() and p.stat().st_mtime_ns == stamp[p]} == {p for p in files if "tile_block=2" in str(p)}
    assert rasters.write_resumably(pixels, wanted, path, 5) == 0


def test_wide_fingerprints_are_searched_in_a_vantage_point_tree(monkeypatch):
    rng = np.random.default_rng(8)
    flips = lambda n, most: np.packbits(rng.random((n, 256)) < rng.random((n, 1)) * most / 256, axis=1).view(np.uint64)
    unlike, middle = rng.integers(0, 2**63, (700, 4)).astype(np.uint64), rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
    prints = np.r_[unlike, middle[0] ^ flips(500, 30), middle[1] ^ flips(300, 50), middle[2] ^ flips(200, 90)][rng.permutation(1700)]
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    near, asking, home = apart <= 64, np.arange(0, 1700, 3), np.arange(0, 1700, 2)
    found = np.zeros((1700, 1700), int)
    simhash.near_pairs(prints, prints, 64, lambda p, q: np.add.at(found, (p, q), 1), home, asking)
    want = np.zeros((1700, 1700), int)
    want[np.ix_(home, asking)] = near[np.ix_(home, asking)]
    assert (found == want).all()
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: compared.append(x.size // 4) or count(x))
    label = simhash.joined(prints, np.arange(1700), np.arange(1700), 64)
    monkeypatch.undo()
    least = np.arange(1700)
    while not (least == (lower := np.where(near, least[None], 1700).min(axis=1))).all():
        least = lower
    # all copies of a middle are left out of the search of what is far from it
    assert (label == least).all() and sum(compared) < 0.9 * 1700**2


def lines_in_two_files(folder, orders, fields):
    """Lines whose orders begin in a small file and end in a larger one, which Spark reads first; ``fields`` of a value, by name."""
    files = [], []
    for k, (own, cut) in enumerate(orders):
        files[0].extend((k, v) for v in own[:cut])
        files[1].extend((k, v) for v in own[cut:])
    files[1].extend((10**6 + k, files[0][0][1]) for k in range(20 * len(files[0])))
    (folder / "lineitem.parquet").mkdir()
    for k, rows in enumerate(files):
        columns = {"l_orderkey": [r[0] for r in rows], "l_suppkey": [1] * len(rows), **{f: [make(r[1]) for r in rows] for f, make in fields.items()}, "l_discount": [0.0] * len(rows), "l_tax": [0.0] * len(rows), "l_returnflag": ["N"] * len(rows)}
        pq.write_table(pa.table(columns), folder / "lineitem.parquet" / f"part-{k}.parquet")


def unlike_sql(spark, folder, name):
    """(ours, SQL's) rows that the other side hasn't, the SQL run on one thread, so that it adds rows in their order."""
    duck = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "orders"):
        if (folder / f"{t}.parquet").exists():
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    query = catalogue.QUERIES[name](spark, str(folder))
    theirs = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in query.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    ours = {tuple(r) for r in query.collect()}
    assert len(theirs) > 0
    return ours - set(theirs), set(theirs) - ours


def test_weighted_means_on_a_half_follow_the_order_of_lines(spark, tmp_path):
    votes = [(25 + a, 25 + a, 25 + a, 25 - a) for k in range(1, 24, 2) for a in (k, -k)]  # 25 and a half of a
    orders = [(p, cut) for v in votes for p in sorted(set(itertools.permutations(v))) for cut in (1, 2, 3)]
    lines_in_two_files(tmp_path, orders, {"l_quantity": float, "l_extendedprice": lambda v: 1000.0})
    assert unlike_sql(spark, tmp_path, "gaussian_weighted_mean") == (set(), set())


def prices_on_a_whole_number(folder):
    """Orders whose lines come to a whole prediction on average, in all their orders, and the pixels they predict."""
    prices = [(23406.48, 62224.02, 15169.5), (67336.66, 86941.51, 88722.18, 13199.65), (70289.01, 57629.52, 88630.22, 22851.25)]
    orders = [(p, cut) for v in prices for p in itertools.permutations(v) for cut in range(1, len(v))]
    lines_in_two_files(folder, orders, {"l_quantity": lambda v: 1.0, "l_extendedprice": float})
    (folder / "orders.parquet").mkdir()
    n = len(orders)
    columns = {"o_orderkey": range(n), "o_custkey": [1] * n, "o_totalprice": [1000.0 * (k % 400) for k in range(n)], "o_orderstatus": ["O"] * n, "o_orderpriority": ["1"] * n}
    pq.write_table(pa.table({c: list(v) for c, v in columns.items()}), folder / "orders.parquet" / "part-0.parquet")


def test_predictions_of_a_mask_follow_the_order_of_lines(spark, tmp_path):
    prices_on_a_whole_number(tmp_path)
    assert unlike_sql(spark, tmp_path, "mask_pair") == (set(), set())


def test_predictions_of_a_matched_raster_follow_the_order_of_lines(spark, tmp_path):
    prices_on_a_whole_number(tmp_path)
    assert unlike_sql(spark, tmp_path, "match_raster") == (set(), set())
