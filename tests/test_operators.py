"""Hand-computed cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import scalars
from parcelwise.operators import accuracy, ensemble, focal, forests, grid, sampling, spatial, trees
from parcelwise.sources import tables as src


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_only_the_last_tile_reaches_the_edge(spark):
    got = rows(grid.tile_grid(spark, 3, 3, 10, 10), "tile_id")
    assert got[0] == (0, 0, 3, 0, 3) and got[7] == (7, 3, 6, 6, 9) and got[8] == (8, 6, 10, 6, 10)


def test_snapping_takes_the_sign_of_the_resolution(spark):
    df = spark.createDataFrame([(-7,), (7,), (31,)], "v int")
    for value, in [(-7,), (7,), (31,)]:
        got = df.where(f"v = {value}").select(scalars.snapped(F.col("v"), 2, 5), scalars.snapped(F.col("v"), 2, -5)).first()
        assert got[0] == value + (2 % 5 - value % 5) and got[1] == value + (2 % -5 - value % -5)


def test_bins_hold_their_upper_end(spark):
    df = spark.createDataFrame([(0,), (10,), (11,), (-1,), (None,)], "v int")
    assert [r[0] for r in df.select(scalars.bin_number(F.col("v"), [(-1, 0), (0, 10), (10, 20)])).collect()] == [0, 1, 2, None, None]


def test_points_on_edges_and_corners(spark):
    rect = spark.createDataFrame([(1, 0, 10, 10, 0)], "set_id int, ul_x int, ul_y int, lr_x int, lr_y int")
    points = spark.createDataFrame([(0, 10), (5, 5), (10, 5), (5, 0), (0, 5), (5, 10)], "x int, y int")
    assert {(r.x, r.y) for r in spatial.points_in_rects(points, rect, "strict", 4).collect()} == {(5, 5)}
    assert {(r.x, r.y) for r in spatial.points_in_rects(points, rect, "half_open", 4).collect()} == {(0, 10), (5, 5), (0, 5), (5, 10)}


def test_rectangles_that_share_an_edge_touch_but_do_not_overlap(spark):
    r = spark.createDataFrame([(1, 0, 10, 10, 0), (2, 10, 10, 20, 0), (3, 5, 5, 12, -3), (4, 100, 100, 101, 99)], "id int, ul_x int, ul_y int, lr_x int, lr_y int")
    pairs = lambda touching: {(x.left_id, x.right_id) for x in spatial.rect_pairs(r, r, touching, 7).collect() if x.left_id < x.right_id}
    assert pairs(False) == {(1, 3), (2, 3)} and pairs(True) == {(1, 2), (1, 3), (2, 3)}
    assert {(x.id, x.region_id) for x in spatial.touching_components(r, 7).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_nearest_takes_the_smaller_on_a_tie(spark):
    v = spark.createDataFrame([(0.0,), (5.0,), (6.0,), (-40.0,), (99.0,)], "x double")
    c = spark.createDataFrame([(0.0,), (10.0,), (10.0,)], "c double")
    assert rows(spatial.nearest(v, c, "x", "c").select("x", "nearest"), "x") == [(-40.0, 0.0), (0.0, 0.0), (5.0, 0.0), (6.0, 10.0), (99.0, 10.0)]


def test_a_tied_vote_goes_to_the_smallest(spark):
    v = spark.createDataFrame([(1, 9), (1, 3), (1, 3), (1, 9), (2, 5), (2, None)], "id int, vote int")
    assert rows(ensemble.percent_vote(v, "id", "vote"), "id") == [(1, 3, 50), (2, 5, 100)]


def test_the_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "v double")
    assert rows(ensemble.histogram(df, "v", 0, 10, 2), "bin") == [(0, 1), (1, 2)]


def test_focal_edges_repeat_the_edge_pixel(spark):
    raster = spark.createDataFrame([(r, c, 3 * r + c if (r, c) != (1, 1) else None) for r in range(3) for c in range(3)], "row int, col int, value int")
    mean = {(r.row, r.col): r.value for r in focal.focal(raster, focal.square(3), "mean").collect()}
    assert (1, 1) not in mean and mean[0, 0] == pytest.approx((4 * 0 + 2 * 1 + 2 * 3) / 8)


@pytest.mark.parametrize("name", ["mean", "mode", "pct_nonzero", "uniform"])
def test_focal_squares_are_those_of_the_whole_raster(spark, name):
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 4, (21, 13)).astype(float)
    whole[rng.random(whole.shape) < 0.1] = np.nan
    raster = spark.createDataFrame([(r, c, None if np.isnan(v) else int(v)) for (r, c), v in np.ndenumerate(whole)], "row long, col long, value int")
    footprint = focal.circle(5)
    padded = np.pad(whole, 2, mode="symmetric")
    near = np.stack([padded[2 + i : 2 + i + 21, 2 + j : 2 + j + 13] for i, j in footprint])
    want = {}
    for (r, c), own in np.ndenumerate(whole):
        v = near[:, r, c][~np.isnan(near[:, r, c])]
        values, n = np.unique(v, return_counts=True)
        want[r, c] = {"mean": v.mean() if len(v) else 0, "mode": values[np.argmax(n)] if len(v) else None, "pct_nonzero": 100 * (v != 0).mean() if len(v) else 0, "uniform": bool((v == own).all())}[name]
    got = {(r.row, r.col): r.value for r in focal.focal(raster, footprint, name, side=4).collect()}
    assert set(got) == {k for k, v in np.ndenumerate(whole) if not np.isnan(v)} and all(got[k] == pytest.approx(want[k]) for k in got)


def test_best_match_is_first_row_by_row_on_a_tie(spark):
    raster = spark.createDataFrame([(0, 0, 4), (0, 1, 6), (1, 0, None), (1, 1, 100)], "row int, col int, value int")
    s = spark.createDataFrame([(0, 0, 5), (9, 9, 1)], "row int, col int, pred int")
    assert [(r.row, r.matched) for r in focal.best_match(s, raster).collect()] == [(0, 4)]


def test_a_raster_is_matched_as_its_samples_are(spark):
    rng = np.random.default_rng(8)
    make = lambda holes: spark.createDataFrame([(r, c, None if rng.random() < holes else int(rng.integers(0, 9))) for r in range(9) for c in range(7)], "row int, col int, value int")
    pred, ref = make(0.2), make(0.5)
    want = {(r.row, r.col): r.matched for r in focal.best_match(pred.where("value IS NOT NULL").withColumnRenamed("value", "pred"), ref).collect()}
    assert {(r.row, r.col): r.matched for r in focal.match_raster(pred, ref, side=4).collect()} == want


def test_a_class_without_predicted_samples_leaves_both_axes(spark):
    # class 3 is mapped on two pixels and seen in one sample, but no sample predicts it
    pixels = [(1, 1, True), (1, 2, True), (1, 3, True), (2, 2, True), (2, 2, False), (3, 3, False), (3, 1, False)] + [(1, 1, False)] * 3
    m = accuracy.by_area(spark.createDataFrame(pixels, "p int, r int, s boolean"), "p", "r", "s")
    got = rows(m.select("pred", "ref", "n", "n_pred", "pct_area", F.round("adj", 6)), "pred", "ref")
    assert got == [(1, 1, 1, 2, 0.6, 0.3), (1, 2, 1, 2, 0.6, 0.3), (2, 1, 0, 1, 0.2, 0.0), (2, 2, 1, 1, 0.2, 0.2)]
    one, two = rows(accuracy.by_class(m), "class")
    assert one[4] == 0.5
    assert two[4] == 1.0 and two[5] is None and two[6] == pytest.approx(0.4)
    o = accuracy.overall(m).first()
    assert o.accuracy == pytest.approx(0.5) and o.expected == pytest.approx((2 * 1 + 1 * 2) / 9) and o.quantity == 1 and o.allocation == 0
    whole = accuracy.with_empty_classes(m, spark.createDataFrame([(1,), (2,), (3,)], "class int"))
    assert whole.count() == 9 and whole.where("pred = 3 OR ref = 3").agg(F.count("n"), F.count("*")).first() == (0, 5)


def test_zones_are_judged_with_and_without_zeros(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 2, 2), ("a", 4, 6), ("a", None, 1), ("z", 0, 3), ("z", 0, 5), ("e", 5, 5), ("e", 7, 7)], "zone string, t int, p int")
    got = {r.zone: r for r in accuracy.zone_fit(df, "zone", "t", "p").collect()}
    assert (got["a"].maeU, got["a"].maeU0, got["a"].rmseM0, got["a"].t1q, got["a"].p3q0, got["a"].r) == (1.0, 2.0, 2.0, 2, 5, 1.0)
    # no pixel but zeros: judged on 0, 0, 1, 1, which agree, so r counts for nothing
    assert (got["z"].r, got["z"].maeU, got["z"].t3q, got["z"].r0, got["z"].p3q0) == (0.0, 0.0, 1, 0.0, 1)
    assert got["e"].r == 0.0 and got["e"].t2q == 6


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 10)] + [("b", 3.0), ("b", None)], "g string, v double")
    assert rows(accuracy.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "g") == [("a", 1.0, 1.5, 4.0), ("b", 3.0, 3.0, 3.0)]


def test_auc_with_ties_and_with_one_class(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("a", True, 2.0), ("b", True, 1.0)], "g string, t boolean, s double")
    assert rows(accuracy.auc(df, "t", "s", ["g"]), "g") == [("a", 0.75, 2, 1), ("b", None, 1, 0)]


def test_agreement_of_equal_series_is_one_and_of_constant_ones_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 4.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r.ac for r in accuracy.agreement(df, "x", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None


def test_samples_follow_the_key_alone(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    chosen = sampling.fraction_of_groups(df, ["g"], "id", 0.63, 1)
    assert rows(chosen.where("chosen").groupBy("g").count(), "g") == [(0, 210), (1, 209), (2, 209)]
    again = sampling.fraction_of_groups(df.repartition(7), ["g"], "id", 0.63, 1)
    assert chosen.exceptAll(again).isEmpty()


def test_clamped_sizes_keep_their_sum(spark):
    got = [r["size"] for r in sampling.clamped_sizes(spark.createDataFrame([(1.0,), (100.0,), (1000.0,)], "n double"), "n", 50, 600).collect()]
    assert sum(got) == pytest.approx(1101) and max(got) < 700


def test_picked_places_keep_apart(spark):
    rng = np.random.default_rng(6)
    places = [(k, "abc"[k % 3], float(x), float(y)) for k, (x, y) in enumerate(rng.random((300, 2)) * 100)]
    df = spark.createDataFrame(places, "id long, s string, x double, y double")
    quota = spark.createDataFrame([("a", 8), ("b", 8), ("c", 200)], "s string, quota int")
    got = sampling.apart(df, quota, "s", "id", 9.0, 3).collect()
    spots = np.array([(r.x, r.y) for r in got])
    gaps = np.hypot(*(spots[:, None] - spots[None]).transpose(2, 0, 1)) + 1000 * np.eye(len(got))
    n = {s: sum(r.s == s for r in got) for s in "abc"}
    assert gaps.min() > 9 and n["a"] == 8 and n["b"] == 8 and 8 < n["c"] < 200
    # no place of an unfilled stratum is left that lies apart from all picked ones
    free = [p for p in places if p[1] == "c" and np.hypot(*(spots - np.array(p[2:])).T).min() > 9]
    assert not free


def test_a_tree_predicts_what_it_was_fitted_to(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + np.where(x[:, 1] > 0.25, 1.0, 0.0)
    pdf = pd.DataFrame({"id": range(400), "set_id": 1, "in_bag": True, "a": x[:, 0], "b": x[:, 1], "y": y})
    df = spark.createDataFrame(pdf)
    nodes = trees.train_sets(df, "y", ["b", "a"], max_depth=3)
    got = trees.predict(df, nodes, ["a", "b"], max_depth=3).join(df, ["id", "set_id"])
    assert got.select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-9
    assert {r.feature for r in trees.importance(nodes).collect()} == {"a", "b"}
    few = trees.train_sets(df.limit(10), "y", ["a", "b"])
    assert few.isEmpty()


def test_a_classifier_and_its_measures(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = np.where(x[:, 0] > 0.6, 3, np.where(x[:, 1] > 0.5, 2, 1))
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "set_id": 1, "in_bag": rng.random(500) < 0.63, "a": x[:, 0], "b": x[:, 1], "y": y}))
    nodes = trees.train_sets(df, "y", ["a", "b"], max_depth=3, classes=True)
    got = trees.predict(df, nodes, ["a", "b"], max_depth=3)
    held = df.where("NOT in_bag")
    m = trees.oob_class_metrics(got, held, "y").first()
    truth = {r.id: r.y for r in held.collect()}
    said = {r.id: r.prediction for r in got.collect()}
    n, hits = len(truth), sum(said[k] == v for k, v in truth.items())
    chance = sum(sum(v == c for v in truth.values()) * sum(said[k] == c for k in truth) for c in (1, 2, 3)) / n**2
    assert m.n == n and m.oob_rate == round(100 * hits / n) > 90 and m.oob_kappa == pytest.approx((hits / n - chance) / (1 - chance))
    assert {(r.label, r.feature) for r in trees.class_importance(df, nodes, "y", ["a", "b"], 3).collect() if r.label == 3} == {(3, "a")}


def led(tree, x, columns):
    nodes = {n[0]: n for n in tree}
    at = nodes[0]
    while at[1] is not None:
        at = nodes[at[3] if x[columns.index(at[1])] <= at[2] else at[4]]
    return at[5]


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("cells", [4_000_000, 500])
def test_a_forest_is_that_of_plain_trees_on_its_bins(spark, classes, cells, monkeypatch):
    monkeypatch.setattr(forests, "MOST_CELLS", cells)
    rng = np.random.default_rng(4)
    x = np.round(rng.random((300, 3)) * 6)
    y = np.where(x[:, 0] > 3, 2, 0) + (x[:, 1] > 2) + (0 if classes else rng.random(300))
    pdf = pd.DataFrame({"id": np.arange(300) * 10**9, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    df = spark.createDataFrame(pdf)
    nodes = forests.grow_forest(df, "y", ["a", "b", "c"], 3, max_depth=3, classes=classes)
    bag = [{r.id for r in df.where(forests.bag_of(F.col("id"), F.lit(t))).collect()} for t in range(3)]
    got = {r.id: r.predictions for r in forests.predict_forest(df, nodes, ["a", "b", "c"]).collect()}
    held = {r.id: r.predictions for r in forests.predict_forest(df, nodes, ["a", "b", "c"], out_of_bag=0.63).collect()}
    for tree in range(3):
        own = np.array([k * 10**9 in bag[tree] for k in range(300)])
        assert 0.5 < own.mean() < 0.75
        plain = trees.fit_tree(x[own], y[own], ["a", "b", "c"], 3, classes=classes)
        for k in range(300):
            assert got[k * 10**9][tree] == pytest.approx(led(plain, x[k], ["a", "b", "c"]))
            assert held[k * 10**9][tree] == (None if own[k] else got[k * 10**9][tree])


def test_a_zero_inflated_forest_is_two_forests_of_plain_trees(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.random((400, 2)) * 5)
    y = np.where((x[:, 0] > 2) & (rng.random(400) < 0.9), 5 + x[:, 1] + rng.random(400), 0.0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "y": y}))
    models = forests.grow_zero_inflated(df, "y", ["a", "b"], 2, max_depth=2)
    got = {r.id: r.predictions for r in forests.predict_zero_inflated(df, models, ["a", "b"]).collect()}
    for tree in range(2):
        own = np.isin(np.arange(400), [r.id for r in df.where(forests.bag_of(F.col("id"), F.lit(tree))).collect()])
        share, value = (trees.fit_tree(x[m], t[m], ["a", "b"], 2) for t, m in (((y != 0).astype(float), own), (y, own & (y != 0))))
        for k in range(400):
            assert got[k][tree] == pytest.approx(led(value, x[k], ["a", "b"]) if led(share, x[k], ["a", "b"]) > 0.5 else 0.0)
    none = forests.grow_forest(df.where("id < 0"), "y", ["a", "b"], 2)
    assert none.isEmpty() and forests.predict_forest(df.limit(1), none, ["a", "b"]).first().predictions == []


def test_numbers_of_single_trees_by_set(spark):
    rng = np.random.default_rng(11)
    x = rng.random((240, 2))
    y = np.where(x[:, 0] > 0.4, np.round(10 * x[:, 1]) + 1, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(240), "set_id": np.arange(240) % 2, "in_bag": rng.random(240) < 0.7, "a": x[:, 0], "b": x[:, 1], "y": y}))
    bag = np.isin(np.arange(240), [r.id for r in df.where("in_bag").collect()])
    got = {r.id: r.prediction for r in trees.predict_zero_inflated(df, trees.zero_inflated(df, "y", ["a", "b"], max_depth=3), ["a", "b"], max_depth=3).collect()}
    for s in range(2):
        own = bag & (np.arange(240) % 2 == s)
        present = trees.fit_tree(x[own], (y[own] != 0).astype(float), ["a", "b"], 3, classes=True)
        value = trees.fit_tree(x[own & (y != 0)], y[own & (y != 0)], ["a", "b"], 3)
        for k in range(s, 240, 2):
            assert got[k] == pytest.approx(led(present, x[k], ["a", "b"]) * led(value, x[k], ["a", "b"]))


def test_models_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, True, float(k), float(k > 40)) for k in range(90)] + [(900, 7, True, None, 1.0)], "id long, set_id long, in_bag boolean, a double, y double")
    nodes = trees.train_sets(df, "y", ["a"])
    trees.write_model(nodes, str(tmp_path / "m"))
    assert trees.read_model(spark, str(tmp_path / "m")).exceptAll(nodes).isEmpty() and nodes.exceptAll(trees.read_model(spark, str(tmp_path / "m"))).isEmpty()
    assert rows(trees.refused(df, nodes, "y", ["a"]), "set_id") == [(7, 1, 0, "too few rows")]


def test_features_and_parameters(spark, tmp_path):
    (tmp_path / "t.geojson").write_text('{"features": [{"properties": {"id": 7, "xmin": 1.5}}, {"properties": {"id": 12, "xmin": 2.5}}]}')
    (tmp_path / "p.txt").write_text("a; 1\nnothing\nb ;two\nx;y;z\n")
    assert rows(src.read_features(spark, str(tmp_path / "t.geojson")).select("id", "xmin"), "id") == [("0007", 1.5), ("0012", 2.5)]
    assert rows(src.read_parameters(spark, str(tmp_path / "p.txt")), "key") == [("a", "1"), ("b", "two")]
    src.write_tsv(spark.range(3), str(tmp_path / "out"))
    assert rows(src.read_tsv(spark, str(tmp_path / "out"), "id long"), "id") == [(0,), (1,), (2,)]
    assert rows(src.find_files(spark, str(tmp_path), "*.txt").select("name"), "name") == [("p.txt",)]


def test_files_of_other_kinds(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.txt", "22")
    assert rows(src.unzipped(spark, str(tmp_path)).select("name", "content"), "name") == [("two.txt", b"22"), ("x/one.txt", b"1")]
    (tmp_path / "d.txt").write_text("3: three\nno\n4:four: 4\n")
    assert rows(src.read_dictionary(spark, str(tmp_path / "d.txt")), "key") == [(3, "three"), (4, "four: 4")]
    (tmp_path / "s.json").write_text('{"n": 3, "name": "a"}')
    assert rows(src.read_settings(spark, str(tmp_path / "s.json")), "key") == [("n", "3"), ("name", "a")]
    src.write_manifest(spark, str(tmp_path / "m"), {"b": 1}, ["x", "y"], "abc")
    src.write_manifest(spark, str(tmp_path / "m"), {"b": 2}, ["z"])
    assert rows(spark.read.json(str(tmp_path / "m")).select("output", "parameters"), "output") == [("x", '{"b": 1}'), ("y", '{"b": 1}'), ("z", '{"b": 2}')]
    files = spark.createDataFrame([("dem_0007_b.img",), ("dem_0007_a.img",), ("dem_0008.img",)], "name string")
    assert rows(src.first_match(files, spark.createDataFrame([(7,), (8,), (9,)], "tile int")), "tile") == [(7, "dem_0007_a.img"), (8, "dem_0008.img")]


def test_layers_rasters_and_sets(spark, tmp_path):
    rects = spark.createDataFrame([(1, 0, 10, 20, 0, "a")], "id int, ul_x int, ul_y int, lr_x int, lr_y int, name string")
    src.write_layer(rects, str(tmp_path / "layer"))
    got = spark.read.json(str(tmp_path / "layer")).first()
    assert got.geometry.coordinates[0][2] == [20.0, 0.0] and (got.properties.id, got.properties.name) == (1, "a")
    pixels = spark.createDataFrame([(0, 0, 1, 120, 1990), (1, 0, 1, -3, 1991)], "row int, col int, tile_id int, value int, year int")
    src.write_raster(pixels, str(tmp_path / "raster"))
    assert dict(spark.read.parquet(str(tmp_path / "raster")).dtypes)["value"] == "tinyint"
    assert dict(grid.narrowest(spark.createDataFrame([(300.4,), (2.5,)], "value double"), "value").dtypes)["value"] == "smallint"
    src.write_series(pixels, str(tmp_path / "series"), {"units": "m"})
    assert rows(spark.read.parquet(str(tmp_path / "series")).select("time", "y", "value"), "time") == [(20, 1, 120), (21, 0, -3)]
    src.write_tsv(spark.createDataFrame([(5, 1)], "set_id long, ul_x int"), str(tmp_path / "tsv" / "sets.txt"))
    assert rows(src.read_support_sets(spark, str(tmp_path / "tsv"), "set_id long, ul_x int"), "set_id") == [(5, 1)]
    spark.createDataFrame([(6, 2)], "set_id long, ul_x int").write.parquet(str(tmp_path / "tsv" / "sets.parquet"))
    assert rows(src.read_support_sets(spark, str(tmp_path / "tsv"), "set_id long, ul_x int"), "set_id") == [(6, 2)]


def test_rules_that_make_no_sense_fall_back():
    assert scalars.drop_rule("oob_rmse <= 70", ["oob_rate", "oob_rmse"]) == ("oob_rmse", "<=", 70, True)
    for text in ("", "rate 3", "rate < 3 > 2", "rate < x", "other < 3", "< 3"):
        assert scalars.drop_rule(text, ["rate"], 5) == ("rate", "<", 5, False)
