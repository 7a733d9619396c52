"""Queries that assemble inputs: predictors, aligned and masked rasters, features with attributes, rules, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accuracy, ensemble, focal, grid, predictors, sampling, spatial
from ..session import cut
from ..sources import tables as src
from .common import rounded
from .grids import GRID, size

sql = src.sql
NODATA = -9999
CELL, SEED = (300, 400), (1234, -321)


def rasters(spark, d):
    """Three predictor rasters by name, each with its own nodata value."""
    p = src.pixels(spark, d)
    price = p.select("row", "col", (F.col("value") / 100).cast("int").alias("value"))
    votes = src.votes(spark, d).groupBy("id").agg(F.max("vote").alias("vote"), F.count("*").alias("lines"))
    v = p.select("id", "row", "col").join(votes, "id")
    return {"vote": (v.select("row", "col", F.col("vote").alias("value")), 50), "price": (price, None), "lines": (v.select("row", "col", F.col("lines").alias("value")), 1)}


def tile_predictors(spark, d):
    pixels = src.pixels(spark, d).select("row", "col", "tile_id")
    return predictors.of_tile(pixels, rasters(spark, d), NODATA)


def assemble_predictors(spark, d):
    """Valid pixels of each support rectangle with their predictors and constants."""
    pixels = src.pixels(spark, d).select("id", "row", "col", "x", "y")
    inside = spatial.points_in_rects(pixels, src.rectangles(spark, d), "half_open").select("set_id", "id", "row", "col")
    rows = predictors.with_constants(predictors.of_tile(inside, rasters(spark, d), NODATA), {"year": 2001, "epoch": 4})
    return predictors.valid(rows, ("lines", "price", "vote"), NODATA).groupBy("set_id").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("vote").alias("vote"), F.sum("lines").alias("lines"), F.min("epoch").alias("epoch"), F.min("year").alias("year"))


def any_predictor(spark, d):
    rows = predictors.of_tile(src.pixels(spark, d).select("id", "row", "col"), rasters(spark, d), NODATA)
    return predictors.valid(rows, ("lines", "vote"), NODATA, any_missing=False).select("id", "lines", "vote")


def rejected_rows(spark, d):
    """Rows that lack a predictor, as the side table beside the complete ones."""
    v = src.votes(spark, d).select("id", F.when(F.col("vote") % 10 != 0, F.col("vote")).alias("vote"), F.when(F.col("tax") > 0, F.col("tax")).alias("tax"))
    kept, rejected = predictors.split_complete(v, ["vote", "tax"])
    of = lambda rows, name: rows.groupBy(F.lit(name).alias("side")).agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))
    return of(kept, "kept").unionByName(of(rejected, "rejected"))


def block_scan(spark, d):
    return grid.blocks(src.pixels(spark, d), 32)


def kernel_window(spark, d):
    samples = src.pairs(spark, d).where("sampled").select("row", "col")
    return focal.windows(samples, src.pixels(spark, d).select("row", "col", F.col("value").cast("int").alias("value")), 5, 3, NODATA)


def layer_with_attributes(spark, d):
    """The geometry of one layer with the attributes of a table, by feature id."""
    r = src.rectangles(spark, d)
    attributes = src.votes(spark, d).groupBy("set_id").agg(F.count("*").alias("n"), F.max("vote").alias("vote"))
    return src.with_attributes(r.select("set_id", spatial.ring_of(*map(F.col, ("ul_x", "ul_y", "lr_x", "lr_y"))).alias("ring")), attributes, "set_id").withColumn("ring", src.well_known("ring"))


def bag_lookup(spark, d):
    """The samples of one set that are in its bag."""
    v = src.votes(spark, d).select("set_id", "id").distinct()
    b = sampling.fraction_of_groups(v, ["set_id"], "id", 0.63, 5)
    return src.samples_of(b.withColumnRenamed("chosen", "in_bag"), 5, True)


def time_series(spark, d):
    """Yearly rasters as a series: years since 1970, rows counted from below."""
    o = src.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), F.col("o_totalprice").alias("value"))
    return src.as_series(o)


def render_scripts(spark, d):
    """One script for each region and segment by a template."""
    regions = src.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    segments = src.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return src.rendered(regions, segments, "run --region {name} --key {key} --segment {segment}").select("name", "segment", "script")


def feature_transforms(spark, d):
    t = grid.transforms(src.rectangles(spark, d), 45, -45, (7, 11))
    return t.select("set_id", *[F.col(c).cast("bigint") for c in ("tx_x", "tx_y", "n_rows", "n_cols")])


def seeded_cells(spark, d):
    """Cells around a seed point that cover the raster."""
    n_rows, n_cols = size(spark, d)
    return grid.seeded_cells(spark, CELL, (0, -30 * n_rows, 30 * n_cols, 0), SEED).select(*[F.col(c).cast("bigint") for c in ("ul_x", "ul_y", "lr_x", "lr_y")])


def snapped_tiles(spark, d):
    """Processing tiles whose edges lie on the nearest edges of support rectangles."""
    r = src.rectangles(spark, d)
    tiles = src.pixels(spark, d).groupBy("tile_id").agg(*[f(F.col(c) + k).cast("bigint").alias(n) for n, c, k, f in (("ul_x", "x", -15, F.min), ("ul_y", "y", 15, F.max), ("lr_x", "x", 15, F.max), ("lr_y", "y", -15, F.min))])
    for a, b in (("ul_x", "lr_x"), ("ul_y", "lr_y")):
        edges = cut(r.select(F.col(a).alias("edge")).union(r.select(F.col(b).alias("edge"))).distinct())
        for c in (a, b):
            tiles = spatial.nearest(tiles, edges, c, "edge").drop(c).withColumnRenamed("nearest", c)
    return tiles.select("tile_id", "ul_x", "ul_y", "lr_x", "lr_y")


def tiles_by_aspect(spark, d):
    """Rows and columns of as many tiles as each supplier's number says, in the raster's shape."""
    rows, cols = grid.tiles_by_aspect(F.col("n"), *size(spark, d))
    return src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("n")).select("n", rows.alias("n_rows"), cols.alias("n_cols"))


def zone_windows(spark, d):
    size = F.broadcast(src.pixels(spark, d).agg((F.max("row") + 1).alias("y_size"), (F.max("col") + 1).alias("x_size")))  # one row
    return grid.zone_windows(src.rectangles(spark, d).crossJoin(size), F.col("y_size"), F.col("x_size"), src.AFFINE)


def align_raster(spark, d):
    p = src.pixels(spark, d)
    moved = p.select("row", "col", F.when(F.col("status") != "P", F.col("value")).alias("value"))
    return grid.aligned(moved, p.select("row", "col", (F.col("value") / 5000).cast("int").alias("value")), 3, -7, -1.0, F.col("value") == 7)


def region_mask(spark, d):
    p = src.pixels(spark, d).select("row", "col", "x", "y", (F.col("value") / 5000).cast("int").alias("value"))
    inside = (F.col("x") > 600) & (F.col("x") < 2100) & (F.col("y") < -300) & (F.col("y") > -1200)
    return grid.masked_outside(p, inside, 255).select("row", "col", "value")


def resample_cubic(spark, d):
    return rounded(grid.halved_cubic(src.pixels(spark, d).withColumn("value", F.col("value").cast("int"))))


def ring_envelopes(spark, d):
    r = src.rectangles(spark, d).select("set_id", spatial.ring_of(*map(F.col, ("ul_x", "ul_y", "lr_x", "lr_y"))).alias("ring"))
    return spatial.with_envelope(r).withColumn("area", scalars.ring_area(F.col("ring"))).where("area > 1").drop("ring")


def points_in_polygons(spark, d):
    """Pixels in triangles over the support rectangles."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, c = corner(F.col("ul_x"), F.col("ul_y")), corner(F.col("lr_x"), F.col("ul_y")), corner(F.col("ul_x"), F.col("lr_y"))
    polygons = src.rectangles(spark, d).select("set_id", F.array(a, b, c, a).alias("ring"))
    return spatial.points_in_polygons(src.pixels(spark, d).select("id", "x", "y"), polygons).groupBy("set_id").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))


def tile_of_point(spark, d):
    """The tile that a raster of tile ids holds at each point; points of the first row or column have none."""
    p = src.pixels(spark, d)
    row, col = scalars.to_row_col(F.col("x"), F.col("y"), src.AFFINE)
    points = p.select("id", row.alias("row"), col.alias("col")).where("row > 0 AND col > 0")
    return points.join(p.select("row", "col", "tile_id"), ["row", "col"], "left").select("id", "tile_id")


def attribute_merges(spark, d):
    """Attributes joined on a field (inner) and on the index (left)."""
    r = src.rectangles(spark, d).select("set_id", "ul_x")
    stats = src.votes(spark, d).groupBy("set_id").agg(F.count("*").alias("n")).where("n > 500")
    names = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), "s_name")
    return r.join(names, "set_id").join(stats, "set_id", "left")


def clip_and_dissolve(spark, d):
    """Rectangles clipped to a window, and what their groups of one tenth cover."""
    c = spatial.clipped(src.rectangles(spark, d).withColumn("part", (F.col("set_id") % 10).cast("int")), 300, -200, 2400, -900)
    return spatial.extents(c, "part")


def oob_map_average(spark, d):
    from .ensembles import oob_map

    return rounded(oob_map(spark, d).agg(F.avg("oob").alias("oob"), F.avg("n_sets").alias("n_sets")), 4)


def importance_share(spark, d):
    from .ensembles import importance_rank

    ranked = importance_rank(spark, d)
    total = F.broadcast(ranked.agg(F.sum("mean").alias("total")))  # one row
    return rounded(ranked.crossJoin(total).select("variable", "rank", (F.col("mean") / F.col("total")).alias("share")), 4)


def kernel_modes(spark, d):
    from .ensembles import raster, samples

    return focal.kernel_modes(raster(spark, d), samples(spark, d))


def paired_kernel_means(spark, d):
    """Whole means of prediction and reference windows at samples, where no best match is sought."""
    p = src.pairs_in_order(spark, d)
    pred, ref = p.select("row", "col", F.col("pred").alias("value")), src.pixels(spark, d).select("row", "col", (F.col("value") / 5000).cast("int").alias("value"))
    return focal.paired_means(p.where("sampled").select("row", "col"), pred, ref)


def zonal_by_source(spark, d):
    p = src.pairs_in_order(spark, d)
    of = lambda c: ensemble.prefixed(ensemble.zonal(p, "priority", {"mean": F.avg(c), "count": F.count(c)}), "priority", c)
    return rounded(of("ref").join(of("pred"), "priority"), 4)


def aggregate_sets(spark, d):
    """Statistics over the rasters that each set has made by itself."""
    by_set = src.votes(spark, d).groupBy("set_id", "id").agg(F.max("vote").alias("vote"))
    return ensemble.statistics(by_set, ["id"], "vote", ["mean", "stdv", "vote", "count"])


def hexagon_histogram(spark, d):
    return rounded(ensemble.hexagons(src.pairs_in_order(spark, d), "ref", "pred", 10.0), 4)


def combination_index(spark, d):
    members = src.votes(spark, d).select("id", "set_id").distinct()
    combos, index = ensemble.numbered_combinations(members, "id", "set_id")
    return index.join(combos.select("combo", "n_pixels", "sets"), "combo").select("id", "combo", "n_pixels", "sets")


def runs_inventory(spark, d):
    """Statistics of several runs (by discount), each without its own nodata value."""
    v = src.votes(spark, d).select(F.round(F.col("discount") * 100).cast("int").alias("run"), F.when(F.col("tax") == 0, -1).otherwise(F.col("vote")).alias("value"))
    return rounded(ensemble.without_extreme(v, "run", "value"), 4)


def trial_averages(spark, d):
    """Error of repeated trials of sampled locations, and its average and median over them."""
    n = 50
    drawn = sampling.repeated_quota(src.pairs_in_order(spark, d).select("id", "tile_id", "ref", "pred"), "tile_id", "id", 2, n, 12)
    diff = F.col("pred") - F.col("ref")
    each = drawn.groupBy("trial").agg(F.sqrt(F.avg(diff * diff)).alias("rmse"), F.count("*").alias("n"))
    return rounded(each.agg(F.avg("rmse").alias("rmse"), F.median("rmse").alias("rmse_median"), F.sum("n").alias("n")), 4)


def cdf_edges(spark, d):
    counts = src.pairs_in_order(spark, d).groupBy("pred").agg(F.count("*").alias("n"))
    return rounded(ensemble.cdf_at(counts, "pred", "n", range(0, 101, 5)))


def pixel_order(spark, d):
    """Predictions made set by set, back at their pixels."""
    v = src.votes(spark, d).select("id", "set_id").distinct()
    by_set = v.groupBy("set_id").agg(F.count("*").alias("n"))
    back = v.join(by_set, "set_id").groupBy("id").agg(F.sum("n").alias("prediction"))
    return src.pixels(spark, d).select("id", "row", "col").join(back, "id", "left").select("row", "col", "prediction")


def first_pixels(spark, d):
    """A fixed number of pixels, the first by a hash."""
    p = src.pixels(spark, d).select("id", scalars.portable_hash(F.col("id"), 21).alias("h"))
    return sampling.first_by(p, "h", 1000).select("id")


def resume_tiles(spark, d):
    """Tile and statistic pairs without an output yet."""
    p = src.pixels(spark, d)
    wanted = p.select("tile_id").distinct().select("tile_id", F.explode(F.array(F.lit("mean"), F.lit("vote"))).alias("stat"))
    made = p.where("tile_id % 3 <> 0").select("tile_id", F.when(F.col("tile_id") % 2 == 0, F.lit("mean")).otherwise(F.lit("vote")).alias("stat")).distinct()
    return src.still_to_do(wanted, made, ["tile_id", "stat"])


def padded_list(spark, d):
    """Customers whose padded id stands in a list."""
    c = src.table(spark, d, "customer").select("c_custkey", scalars.four_digits(F.col("c_custkey")).alias("tsa"))
    return c.where(F.col("tsa").isin(*[f"{k:04d}" for k in range(7, 150, 11)]))


def first_file(spark, d):
    """For each tile the first file, by name, whose name holds its padded id."""
    files = src.table(spark, d, "customer").select(F.concat(F.lit("dem_"), scalars.four_digits(F.col("c_custkey")), F.lit("_"), F.col("c_nationkey"), F.lit(".img")).alias("file"))
    ids = src.table(spark, d, "supplier").select("s_suppkey", scalars.four_digits(F.col("s_suppkey")).alias("tile"))
    return spatial.first_name_holding(files, ids, "file", "tile", 4).groupBy("s_suppkey").agg(F.min("file").alias("file"))


def rules(spark, d):
    """Which sets several drop rules leave; a malformed one means rate < 0."""
    sets = src.votes(spark, d).groupBy("set_id").agg(F.avg("vote").cast("int").alias("rate"))
    out = None
    for text in ("rate < 26", "rate >= 25", "rate <= 24", "rate > 25", "rate about 3", "other < 3", "rate < x"):
        rule = scalars.drop_rule(text, ["rate"])
        own = sets.where(~scalars.dropped(rule)).groupBy(F.lit(text).alias("rule")).agg(F.count("*").alias("n")).withColumn("understood", F.lit(rule[3]))
        out = own if out is None else out.unionByName(own)
    return out


def constant_columns(spark, d):
    text = F.concat(F.lit("year:"), 1990 + F.col("r_regionkey"), F.lit(",zone: "), F.col("r_name"))
    r = src.table(spark, d, "region").select("r_regionkey", F.posexplode(scalars.constants(text)).alias("k", "c"))
    return r.select("r_regionkey", "k", "c.key", "c.value")


def prefix_metrics(spark, d):
    li = src.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("v_a"), (F.col("l_discount") * 100).alias("v_b"), (F.col("l_tax") * 100).alias("v_c"))
    found = scalars.row_metrics([F.col(c) for c in scalars.starting_with(li.columns, "v_")], equal=4.0, between=(2, 8))
    return rounded(li.select("l_orderkey", *[c.alias(n) for n, c in found.items()]))


def kernel_sum(spark, d):
    near = src.pixels(spark, d).select("id", *[(F.col("id") * k % 7).alias(f"{m}_{k}") for m in ("old", "new") for k in (1, 2, 3)])
    return near.select("id", *scalars.kernel_sums(near.columns, ["old", "new"]))


def path_templates(spark, d):
    t = src.pixels(spark, d).select("tile_id").distinct()
    return t.select("tile_id", src.filled(F.lit("/maps/{tile}/band_{year}.tif"), {"tile": scalars.four_digits(F.col("tile_id")), "year": F.lit(2001)}).alias("path"))


def chunked_list(spark, d):
    """Tile ids in order, in lists of seven."""
    t = accuracy.numbered(src.pixels(spark, d).select("tile_id").distinct(), "tile_id")
    chunks = t.withColumn("chunk", F.floor(F.col("place") / 7).cast("int"))
    return chunks.groupBy("chunk").agg(F.concat_ws("_", F.transform(F.array_sort(F.collect_list("tile_id")), lambda x: x.cast("string"))).alias("tiles"))


def positional_merge(spark, d):
    """Rectangles in order beside the tiles in order, row by row."""
    tiles = src.pixels(spark, d).groupBy("tile_id").agg(F.count("*").alias("n"))
    return accuracy.side_by_side(src.rectangles(spark, d).select("set_id", "ul_x"), tiles, "set_id", "tile_id")


def epoch_tables(spark, d):
    day = F.dayofmonth("ts")
    kinds = F.array(*[F.struct(F.lit(n).alias("length"), F.lit(s).alias("start")) for n, s in scalars_kinds()])
    e = src.table(spark, d, "events").select((day % 8).alias("epoch")).distinct().select("epoch", F.explode(kinds).alias("k"))
    year = F.col("epoch")
    for n, s in scalars_kinds():
        year = F.when((F.col("k.length") == n) & (F.col("k.start") == s), scalars.epoch_year(F.col("epoch"), n, s)).otherwise(year)
    return e.select("epoch", "k.length", "k.start", year.cast("int").alias("year"))


def scalars_kinds():
    return [(n, 1985 if era == "early" else 2000) for era, n in scalars.FIRST_YEARS]


def pair_split(spark, d):
    p = src.votes(spark, d).join(src.pixels(spark, d).select("id", "row", "col"), "id").select("id", "row", "col")
    out = sampling.split_by_pairs(p, ["row", "col"], 0.8, 9)
    also = sampling.split_by_pairs(p, ["row", "col"], 0.02, 9, separately=True)
    of = lambda rows, name: rows.groupBy(F.lit(name).alias("kind"), "train").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))
    return of(out, "pairs").unionByName(of(also, "separately"))


def tile_bin_sample(spark, d):
    p = src.pairs_in_order(spark, d).withColumn("bin", F.floor(F.col("pred") / 10).cast("int"))
    return sampling.quota_split(p, ["tile_id", "bin"], "id", F.lit(5), 0.8, 8).select("tile_id", "bin", "id", "train")


def presence_absence(spark, d):
    p = src.pixels(spark, d)
    return sampling.presence_absence(p.select("id", F.col("custkey").alias("zone"), "status"), "zone", "id", F.col("status") == "P", 400, 0.7, 0.8, 4)


def year_columns(spark, d):
    p = src.pixels(spark, d).select("id", "tile_id", F.col("id").alias("cover_2001"), (-F.col("id")).alias("cover_2011"))
    return sampling.year_of(p, ["tile_id"], "id", ["cover_2001", "cover_2011"], "cover", 14).select("id", "cover", "source")


def select_psus(spark, d):
    """Tiles picked up to each stratum's quota, none nearer to another than four tiles, halves tagged by year."""
    tiles = src.pixels(spark, d).groupBy("tile_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("area")).withColumn("stratum", F.get(F.array(F.lit("forest"), F.lit("WATER"), F.lit("plain")), (F.col("tile_id") % 3).cast("int"))).where("stratum <> 'WATER'")
    quota = sampling.strata_quota(tiles.groupBy("stratum").agg(F.sum("area").alias("area")), "area", 24).select("stratum", "quota")
    picked = sampling.apart(tiles, quota, "stratum", "tile_id", 1200.0, 5)
    return sampling.fraction_of_groups(picked, ["stratum"], "tile_id", 0.5, 6).select("tile_id", "stratum", F.when(F.col("chosen"), F.lit("2001")).otherwise(F.lit("2011")).alias("tag"))


def H(k, s):
    return f"((({k}) * 2654435761 + {s} * 40503) % 4294967296 * 1597334677 + 12345) % 4294967296"


RASTERS = f"""vt AS (SELECT id, max(vote) AS vote, count(*) AS lines FROM votes GROUP BY id),
  pr AS (SELECT p.*, CAST(coalesce(CASE WHEN v.lines <> 1 THEN v.lines END, {NODATA}) AS SMALLINT) AS lines, CAST(trunc(p.value / 100) AS SMALLINT) AS price, CAST(coalesce(CASE WHEN v.vote <> 50 THEN v.vote END, {NODATA}) AS SMALLINT) AS vote FROM px p LEFT JOIN vt v USING (id))"""
ZONE = """w AS (SELECT r.*, CAST(trunc(ul_y / -30.0) AS INTEGER) AS r0, CAST(trunc(ul_x / 30.0) AS INTEGER) AS c0, CAST((lr_x - ul_x) // 30 AS INTEGER) AS n, h, w FROM rect r, (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM px)),
  e AS (SELECT *, greatest(r0, 0) AS rf, least(r0 + n, h) AS rt, greatest(c0, 0) AS cf, least(c0 + n, w) AS ct FROM w)"""
NEAREST = "arg_min(edge, (abs(edge - {c}), edge))"
LIST = ", ".join(f"'{k:04d}'" for k in range(7, 150, 11))
EPOCHS = " ".join(f"WHEN length = {n} AND start = {1985 if era == 'early' else 2000} AND epoch <= {last} THEN {first} + length * epoch" for ((era, n), first), last in zip([((e, n), y) for (e, n), y in scalars.FIRST_YEARS.items()], scalars.LAST_EPOCHS.values(), strict=True))
KINDS = ", ".join(f"({n}, {s})" for n, s in scalars_kinds())
M = "[CASE WHEN l_quantity > 5 THEN l_quantity END, l_discount * 100, l_tax * 100]"
HEX = """f AS (SELECT ref / 10.0::DOUBLE AS fx, pred / (10.0::DOUBLE * sqrt(3.0::DOUBLE)) AS fy FROM pair), g AS (SELECT *, round(fx) AS a, round(fy) AS b, floor(fx) AS c, floor(fy) AS d FROM f),
  k AS (SELECT *, (fx - a) * (fx - a) + 3 * (fy - b) * (fy - b) < (fx - c - 0.5) * (fx - c - 0.5) + 3 * (fy - d - 0.5) * (fy - d - 0.5) AS first FROM g)"""
PAIRS = f"""q AS (SELECT v.id, p."row", p.col FROM votes v JOIN px p USING (id)), u AS (SELECT DISTINCT "row", col FROM q), k AS (SELECT *, ({H('("row" * 100000 + col) % 2147483647', 9)}) * 4096 + ("row" * 100000 + col) % 4096 AS h, count(*) OVER () AS n FROM u),
  o AS (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM k), a AS (SELECT "row", col FROM o WHERE rn <= floor(0.8 * n)), s AS (SELECT "row", col FROM o WHERE rn <= floor(0.02 * n))"""

ALL = {
    "tile_predictors": (tile_predictors, sql("votes", "px", body=f', {RASTERS} SELECT "row", col, tile_id, lines, price, vote FROM pr')),
    "assemble_predictors": (assemble_predictors, sql("votes", "px", "rect", body=f""", {RASTERS} SELECT r.set_id, count(*) AS n, CAST(sum(p.price) AS BIGINT) AS price, CAST(sum(p.vote) AS BIGINT) AS vote, CAST(sum(p.lines) AS BIGINT) AS lines, 4 AS epoch, 2001 AS year
      FROM pr p JOIN rect r ON p.x >= r.ul_x AND p.x < r.lr_x AND p.y > r.lr_y AND p.y <= r.ul_y WHERE p.lines <> {NODATA} AND p.vote <> {NODATA} AND p.price <> {NODATA} GROUP BY r.set_id""")),
    "any_predictor": (any_predictor, sql("votes", "px", body=f", {RASTERS} SELECT id, lines, vote FROM pr WHERE lines <> {NODATA} OR vote <> {NODATA}")),
    "rejected_rows": (rejected_rows, sql("votes", body="SELECT CASE WHEN vote % 10 <> 0 AND tax > 0 THEN 'kept' ELSE 'rejected' END AS side, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM votes GROUP BY 1")),
    "block_scan": (block_scan, sql("px", body='SELECT CAST("row" // 32 AS INTEGER) AS block_row, CAST(col // 32 AS INTEGER) AS block_col, count(value) AS n, min(value) AS least, max(value) AS most FROM px GROUP BY ALL')),
    "kernel_window_5x3": (kernel_window, sql("pair", body=f"""SELECT s."row", s.col, CAST((i + 2) * 3 + j + 2 AS INTEGER) AS k, coalesce(CAST(trunc(b.value) AS INTEGER), {NODATA}) AS value FROM (SELECT * FROM pair WHERE sampled) s CROSS JOIN range(-2, 3) x(i) CROSS JOIN range(-1, 2) y(j) LEFT JOIN px b ON b."row" = s."row" + i AND b.col = s.col + j""")),
    "layer_with_attributes": (layer_with_attributes, sql("rect", "votes", body=""", a AS (SELECT set_id, count(*) AS n, max(vote) AS vote FROM votes GROUP BY set_id)
      SELECT r.set_id, 'POLYGON((' || array_to_string([ul_x || ' ' || ul_y, lr_x || ' ' || ul_y, lr_x || ' ' || lr_y, ul_x || ' ' || lr_y, ul_x || ' ' || ul_y], ', ') || '))' AS ring, a.n, a.vote FROM rect r JOIN a USING (set_id)""")),
    "bag_lookup": (bag_lookup, sql("votes", body=f""", b AS (SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY {H('id', 5)}, id) <= floor(0.63 * count(*) OVER (PARTITION BY set_id)) AS in_bag FROM (SELECT DISTINCT set_id, id FROM votes)) SELECT id FROM b WHERE set_id = 5 AND in_bag""")),
    "time_series": (time_series, """SELECT CAST(year(o_orderdate) - 1970 AS INTEGER) AS time, CAST((SELECT max(o_orderkey) // 100 FROM orders) - o_orderkey // 100 AS INTEGER) AS y, CAST(o_orderkey % 100 AS INTEGER) AS x, o_totalprice AS value FROM orders"""),
    "render_scripts": (render_scripts, "SELECT r_name AS name, segment, 'run --region ' || r_name || ' --key ' || r_regionkey || ' --segment ' || segment AS script FROM region, (SELECT DISTINCT c_mktsegment AS segment FROM customer)"),
    "feature_transforms": (feature_transforms, sql("rect", body="SELECT set_id, ul_x + 7 - ((ul_x % 45) + 45) % 45 AS tx_x, CAST(ul_y + (11 - 45) + (((-ul_y) % 45) + 45) % 45 AS BIGINT) AS tx_y, CAST(ceil((ul_y - lr_y) / 45.0) AS BIGINT) AS n_rows, CAST(ceil((lr_x - ul_x) / 45.0) AS BIGINT) AS n_cols FROM rect")),
    "seeded_cells": (seeded_cells, sql("px", body=f""", {GRID}, i AS (SELECT h, unnest(range(-4, CAST(trunc((30 * w - 1234) / 400.0) AS BIGINT) + 1)) AS i FROM z), j AS (SELECT i, unnest(range(-CAST(trunc((30 * h - 321) / 300.0) AS BIGINT), 3)) AS j FROM i)
      SELECT 1234 + i * 400 AS ul_x, -321 + j * 300 AS ul_y, 1234 + i * 400 + 400 AS lr_x, -321 + j * 300 - 300 AS lr_y FROM j""")),
    "snapped_tiles": (snapped_tiles, sql("px", "rect", body=f""", t AS (SELECT tile_id, min(x - 15) AS ul_x, max(y + 15) AS ul_y, max(x + 15) AS lr_x, min(y - 15) AS lr_y FROM px GROUP BY tile_id), ex AS (SELECT ul_x AS edge FROM rect UNION SELECT lr_x FROM rect), ey AS (SELECT ul_y AS edge FROM rect UNION SELECT lr_y FROM rect)
      SELECT tile_id, """ + ", ".join(f"(SELECT {NEAREST.format(c='t.' + c)} FROM {e}) AS {c}" for c, e in (("ul_x", "ex"), ("ul_y", "ey"), ("lr_x", "ex"), ("lr_y", "ey"))) + " FROM t")),
    "tiles_by_aspect": (tiles_by_aspect, sql("px", body=f", {GRID} SELECT n, r AS n_rows, CAST(n // r AS INTEGER) AS n_cols FROM (SELECT CAST(s_suppkey AS BIGINT) AS n, greatest(CAST(trunc(sqrt(s_suppkey / (w / CAST(h AS DOUBLE)))) AS INTEGER), 1) AS r FROM supplier, z)")),
    "zone_windows": (zone_windows, sql("px", "rect", body=f", {ZONE} SELECT set_id, rf AS row_from, rt AS row_to, rf - r0 AS zone_row_from, rt - r0 AS zone_row_to, cf AS col_from, ct AS col_to, cf - c0 AS zone_col_from, ct - c0 AS zone_col_to FROM e WHERE rf < rt AND cf < ct")),
    "align_raster": (align_raster, sql("px", body="""SELECT p."row", p.col, coalesce(CASE WHEN trunc(p.value / 5000) <> 7 AND m.status <> 'P' THEN m.value END, -1.0) AS value FROM px p LEFT JOIN px m ON p."row" = m."row" + 3 AND p.col = m.col - 7""")),
    "region_mask": (region_mask, sql("px", body='SELECT "row", col, CASE WHEN x > 600 AND x < 2100 AND y < -300 AND y > -1200 THEN CAST(trunc(value / 5000) AS INTEGER) ELSE 255 END AS value FROM px')),
    "resample_cubic": (resample_cubic, sql("px", body=""", w AS (SELECT * FROM (VALUES (-1, -0.0625::DOUBLE), (0, 0.5625), (1, 0.5625), (2, -0.0625)) t(k, w)), s AS (SELECT p."row" - a.k AS r, p.col - b.k AS c, trunc(p.value) * a.w * b.w AS part FROM px p, w a, w b)
      SELECT CAST(r // 2 AS INTEGER) AS "row", CAST(c // 2 AS INTEGER) AS col, round(sum(part), 6) AS value FROM s WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY r, c HAVING count(*) = 16""")),
    "ring_envelopes": (ring_envelopes, sql("rect", body="SELECT set_id, CAST(ul_x AS DOUBLE) AS min_x, CAST(lr_x AS DOUBLE) AS max_x, CAST(lr_y AS DOUBLE) AS min_y, CAST(ul_y AS DOUBLE) AS max_y, CAST((lr_x - ul_x) * (ul_y - lr_y) AS DOUBLE) AS area FROM rect WHERE (lr_x - ul_x) * (ul_y - lr_y) > 1")),
    "points_in_polygons": (points_in_polygons, sql("px", "rect", body="SELECT set_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM px p JOIN rect r ON p.x > r.ul_x AND p.y < r.ul_y AND p.y > r.lr_y AND p.x < r.lr_x AND (p.x - r.ul_x) / CAST(r.lr_x - r.ul_x AS DOUBLE) + (r.ul_y - p.y) / CAST(r.ul_y - r.lr_y AS DOUBLE) < 1 GROUP BY set_id")),
    "tile_of_point": (tile_of_point, sql("px", body='SELECT id, tile_id FROM px WHERE "row" > 0 AND col > 0')),
    "attribute_merges": (attribute_merges, sql("rect", "votes", body=", n AS (SELECT set_id, count(*) AS n FROM votes GROUP BY set_id HAVING count(*) > 500) SELECT r.set_id, r.ul_x, s.s_name, n.n FROM rect r JOIN supplier s ON s.s_suppkey = r.set_id LEFT JOIN n USING (set_id)")),
    "clip_and_dissolve": (clip_and_dissolve, sql("rect", body=""", c AS (SELECT CAST(set_id % 10 AS INTEGER) AS part, greatest(ul_x, 300) AS ul_x, least(ul_y, -200) AS ul_y, least(lr_x, 2400) AS lr_x, greatest(lr_y, -900) AS lr_y FROM rect)
      SELECT part, count(*) AS n, min(ul_x) AS ul_x, max(ul_y) AS ul_y, max(lr_x) AS lr_x, min(lr_y) AS lr_y FROM c WHERE ul_x < lr_x AND lr_y < ul_y GROUP BY part""")),
    "oob_map_average": (oob_map_average, sql("votes", body=", r AS (SELECT set_id, trunc(avg(vote)) AS rate FROM votes GROUP BY set_id), o AS (SELECT id, CAST(round_even(avg(rate), 0) AS INTEGER) AS oob, count(*) AS n_sets FROM (SELECT DISTINCT id, set_id FROM votes) JOIN r USING (set_id) GROUP BY id) SELECT round(avg(oob), 4) AS oob, round(avg(n_sets), 4) AS n_sets FROM o")),
    "importance_share": (importance_share, """WITH imp AS (SELECT l_suppkey, round(avg(l_discount * 10), 6) AS l_discount, round(avg(l_quantity / 50), 6) AS l_quantity, round(avg(l_tax * 12), 6) AS l_tax FROM lineitem GROUP BY 1),
      m AS (SELECT variable, round(avg(value), 6) AS mean FROM (SELECT 'l_discount' AS variable, l_discount AS value FROM imp UNION ALL SELECT 'l_quantity', l_quantity FROM imp UNION ALL SELECT 'l_tax', l_tax FROM imp) GROUP BY variable)
      SELECT variable, CAST(row_number() OVER (ORDER BY mean DESC, variable) AS INTEGER) AS rank, round(mean / sum(mean) OVER (), 4) AS share FROM m"""),
    "kernel_modes_3x3": (kernel_modes, sql("pair", body=""", r AS (SELECT "row", col, CAST(trunc(value / 20000) AS INTEGER) AS value FROM px), c AS (SELECT s."row", s.col, b.value, count(*) AS n FROM (SELECT * FROM pair WHERE sampled) s JOIN r b ON abs(b."row" - s."row") <= 1 AND abs(b.col - s.col) <= 1 GROUP BY ALL)
      SELECT "row", col, arg_max(value, (n, -value)) AS mode, max(n) AS count FROM c GROUP BY ALL""")),
    "paired_kernel_means": (paired_kernel_means, sql("pair", body=""", s AS (SELECT "row", col FROM pair WHERE sampled), a AS (SELECT s."row", s.col, CAST(trunc(avg(b.pred)) AS INTEGER) AS pred FROM s JOIN pair b ON abs(b."row" - s."row") <= 1 AND abs(b.col - s.col) <= 1 GROUP BY ALL),
      c AS (SELECT s."row", s.col, CAST(trunc(avg(trunc(b.value / 5000))) AS INTEGER) AS ref FROM s JOIN px b ON abs(b."row" - s."row") <= 1 AND abs(b.col - s.col) <= 1 GROUP BY ALL) SELECT a."row", a.col, a.pred, c.ref FROM a JOIN c ON a."row" = c."row" AND a.col = c.col""")),
    "zonal_by_source": (zonal_by_source, sql("pair", body="SELECT priority, round(avg(ref), 4) AS ref_mean, count(ref) AS ref_count, round(avg(pred), 4) AS pred_mean, count(pred) AS pred_count FROM pair GROUP BY priority")),
    "hexagon_histogram": (hexagon_histogram, sql("pair", body=f", {HEX} SELECT round(CASE WHEN first THEN a ELSE c + 0.5 END * 10.0::DOUBLE, 4) AS hx, round(CASE WHEN first THEN b ELSE d + 0.5 END * (10.0::DOUBLE * sqrt(3.0::DOUBLE)), 4) AS hy, count(*) AS n FROM k GROUP BY 1, 2")),
    "combination_index": (combination_index, sql("votes", body=""", c AS (SELECT id, string_agg(CAST(set_id AS VARCHAR), '_' ORDER BY set_id) AS sets FROM (SELECT DISTINCT id, set_id FROM votes) GROUP BY id), g AS (SELECT sets, min(id) AS combo, count(*) AS n_pixels FROM c GROUP BY sets)
      SELECT c.id, g.combo, g.n_pixels, g.sets FROM c JOIN g USING (sets)""")),
    "aggregate_sets": (aggregate_sets, sql("votes", body=f""", s AS (SELECT set_id, id, max(vote) AS vote FROM votes GROUP BY ALL), n AS (SELECT id, vote, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT id, arg_max(vote, (n, -vote)) AS vote FROM n GROUP BY id)
      SELECT id, CAST(round_even(avg(s.vote), 0) AS INTEGER) AS mean, CAST(round_even(round(stddev_pop(s.vote), 6), 0) AS INTEGER) AS stdv, any_value(m.vote) AS vote, count(*) AS count FROM s JOIN m USING (id) GROUP BY id""")),
    "runs_inventory": (runs_inventory, sql("votes", body=""", v AS (SELECT CAST(round(discount * 100) AS INTEGER) AS run, CASE WHEN tax = 0 THEN -1 ELSE vote END AS value FROM votes), e AS (SELECT run, CASE WHEN min(value) < 0 THEN min(value) ELSE max(value) END AS nodata FROM v GROUP BY run)
      SELECT run, count(*) AS n, count(*) FILTER (WHERE value = nodata) AS n_nodata, any_value(nodata) AS nodata, round(avg(value) FILTER (WHERE value <> nodata), 4) AS mean FROM v JOIN e USING (run) GROUP BY run""")),
    "trial_averages": (trial_averages, sql("pair", body=f""", t AS (SELECT p.*, k AS trial, row_number() OVER (PARTITION BY k, tile_id ORDER BY {H('id * 50 + k', 12)}, id * 50 + k) AS rn FROM pair p, range(50) r(k)), e AS (SELECT trial, sqrt(avg((pred - ref) * CAST(pred - ref AS DOUBLE))) AS rmse, count(*) AS n FROM t WHERE rn <= 2 GROUP BY trial)
      SELECT round(avg(rmse), 4) AS rmse, round(median(rmse), 4) AS rmse_median, CAST(sum(n) AS BIGINT) AS n FROM e""")),
    "cdf_edges": (cdf_edges, sql("pair", body="SELECT CAST(k * 5 AS INTEGER) AS edge, round(count(*) FILTER (WHERE pred <= k * 5) / CAST(count(*) AS DOUBLE), 6) AS share FROM pair, range(21) t(k) GROUP BY k")),
    "pixel_order": (pixel_order, sql("px", "votes", body=', v AS (SELECT DISTINCT id, set_id FROM votes), s AS (SELECT set_id, count(*) AS n FROM v GROUP BY set_id), b AS (SELECT id, CAST(sum(n) AS BIGINT) AS prediction FROM v JOIN s USING (set_id) GROUP BY id) SELECT "row", col, prediction FROM px LEFT JOIN b USING (id)')),
    "first_pixels": (first_pixels, sql("px", body=f"SELECT id FROM px ORDER BY {H('id', 21)} LIMIT 1000")),
    "resume_tiles": (resume_tiles, sql("px", body="SELECT tile_id, stat FROM (SELECT DISTINCT tile_id FROM px), (VALUES ('mean'), ('vote')) s(stat) WHERE tile_id % 3 = 0 OR stat <> CASE WHEN tile_id % 2 = 0 THEN 'mean' ELSE 'vote' END")),
    "padded_list": (padded_list, f"SELECT c_custkey, right('0000' || c_custkey, 4) AS tsa FROM customer WHERE right('0000' || c_custkey, 4) IN ({LIST})"),
    "first_file": (first_file, """WITH f AS (SELECT 'dem_' || right('0000' || c_custkey, 4) || '_' || c_nationkey || '.img' AS file FROM customer) SELECT s_suppkey, min(file) AS file FROM f JOIN supplier ON file LIKE '%' || right('0000' || s_suppkey, 4) || '%' GROUP BY s_suppkey"""),
    "drop_rules": (rules, sql("votes", body=""", s AS (SELECT set_id, CAST(trunc(avg(vote)) AS INTEGER) AS rate FROM votes GROUP BY set_id) SELECT rule, count(*) AS n, any_value(ok) AS understood FROM s, (VALUES ('rate < 26', true), ('rate >= 25', true), ('rate <= 24', true), ('rate > 25', true), ('rate about 3', false), ('other < 3', false), ('rate < x', false)) t(rule, ok)
      WHERE NOT CASE rule WHEN 'rate < 26' THEN rate < 26 WHEN 'rate >= 25' THEN rate >= 25 WHEN 'rate <= 24' THEN rate <= 24 WHEN 'rate > 25' THEN rate > 25 ELSE rate < 0 END GROUP BY rule""")),
    "constant_columns": (constant_columns, "SELECT r_regionkey, CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN 'year' ELSE 'zone' END AS key, CASE WHEN k = 0 THEN CAST(1990 + r_regionkey AS VARCHAR) ELSE r_name END AS value FROM region, range(2) t(k)"),
    "prefix_metrics": (prefix_metrics, f"""SELECT l_orderkey, round(list_avg(h), 6) AS mean, round(list_max(h), 6) AS max, round(list_min(h), 6) AS min, CAST(len(h) AS INTEGER) AS num_pix_with_data, round(m[2], 6) AS mid_pix, round(list_median(h), 6) AS median, round(list_stddev_pop(h), 6) AS stdev,
      CAST(len(list_filter(h, lambda x: x = 4.0)) AS INTEGER) AS num_pix_equal, CAST(len(list_filter(h, lambda x: x >= 2 AND x < 8)) AS INTEGER) AS num_pix_between FROM (SELECT l_orderkey, m, list_filter(m, lambda x: x IS NOT NULL) AS h FROM (SELECT l_orderkey, {M} AS m FROM lineitem))"""),
    "kernel_sum": (kernel_sum, sql("px", body="SELECT id, " + ", ".join(f"2 * (id * {k} % 7) AS sum_old_new_{k}" for k in (1, 2, 3)) + " FROM px")),
    "path_templates": (path_templates, sql("px", body="SELECT DISTINCT tile_id, '/maps/' || right('0000' || tile_id, 4) || '/band_2001.tif' AS path FROM px")),
    "chunked_list": (chunked_list, sql("px", body="SELECT CAST(k // 7 AS INTEGER) AS chunk, string_agg(CAST(tile_id AS VARCHAR), '_' ORDER BY tile_id) AS tiles FROM (SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS k FROM (SELECT DISTINCT tile_id FROM px)) GROUP BY 1")),
    "positional_merge": (positional_merge, sql("px", "rect", body=", a AS (SELECT row_number() OVER (ORDER BY set_id) - 1 AS place, set_id, ul_x FROM rect), b AS (SELECT row_number() OVER (ORDER BY tile_id) - 1 AS place, tile_id, n FROM (SELECT tile_id, count(*) AS n FROM px GROUP BY 1)) SELECT * FROM a FULL JOIN b USING (place)")),
    "epoch_tables": (epoch_tables, f"SELECT CAST(epoch AS INTEGER) AS epoch, length, start, CAST(CASE {EPOCHS} ELSE epoch END AS INTEGER) AS year FROM (SELECT DISTINCT day(ts) % 8 AS epoch FROM events), (VALUES {KINDS}) t(length, start)"),
    "pair_split": (pair_split, sql("px", "votes", body=f""", {PAIRS} SELECT 'pairs' AS kind, a."row" IS NOT NULL AS train, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM q LEFT JOIN a ON q."row" = a."row" AND q.col = a.col GROUP BY 2
      UNION ALL SELECT 'separately', "row" IN (SELECT "row" FROM s) AND col IN (SELECT col FROM s), count(*), CAST(sum(id) AS BIGINT) FROM q GROUP BY 2""")),
    "tile_bin_sample": (tile_bin_sample, sql("pair", body=f""", b AS (SELECT tile_id, CAST(pred // 10 AS INTEGER) AS bin, id FROM pair), r AS (SELECT *, row_number() OVER (PARTITION BY tile_id, bin ORDER BY {H('id', 8)}, id) AS rn, count(*) OVER (PARTITION BY tile_id, bin) AS n FROM b)
      SELECT tile_id, bin, id, rn <= floor(least(n, 5) * 0.8) AS train FROM r WHERE rn <= 5""")),
    "presence_absence": (presence_absence, sql("px", body=f""", z AS (SELECT id, custkey AS zone, status <> 'P' AS present, CASE WHEN status = 'P' THEN 'absent' WHEN {H('custkey', 4)} < {int(0.7 * 4294967296)} THEN 'train' ELSE 'test' END AS side FROM px),
      r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {H('id', 5)}, id) AS rn, count(*) OVER (PARTITION BY side) AS n, CASE side WHEN 'absent' THEN 200 WHEN 'train' THEN {int(200 * 0.8)} ELSE {int(200 * (1 - 0.8))} END AS quota FROM z)
      SELECT id, zone, present, CASE WHEN side = 'absent' THEN rn <= floor(least(n, quota) * 0.8) ELSE side = 'train' END AS train FROM r WHERE rn <= quota""")),
    "year_columns": (year_columns, sql("px", body=f""", r AS (SELECT id, least(floor((row_number() OVER (PARTITION BY tile_id ORDER BY {H('id', 14)}, id) - 1) / floor(count(*) OVER (PARTITION BY tile_id) / 2.0)), 1) AS k FROM px) SELECT id, CASE WHEN k = 0 THEN id ELSE -id END AS cover, CASE WHEN k = 0 THEN 'cover_2001' ELSE 'cover_2011' END AS source FROM r""")),
    "select_psus": (select_psus, None),
}
