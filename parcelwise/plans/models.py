"""Queries that train and apply trees (checked by tests, since SQL can't fit them), and on terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import focal, forests, sampling, spatial, trees
from ..session import cut
from ..sources import tables as src
from .common import rounded

COLUMNS = ["discount", "price", "tax"]


def observations(spark, d):
    v = src.votes(spark, d)
    return v.groupBy("id").agg(F.avg("discount").alias("discount"), F.avg("price").alias("price"), F.avg("tax").alias("tax")).join(src.pairs(spark, d).select("id", "ref", "x", "y"), "id")


def sampled(spark, d, rects=None):
    """Observations in each support rectangle, 63 percent of them in bag, dealt by neighbouring sets."""
    inside = trees.dealt(spatial.points_in_rects(observations(spark, d), rects or src.rectangles(spark, d), "strict"))
    return sampling.fraction_of_groups(inside, ["_sets", "set_id"], "id", 0.63, 5).withColumnRenamed("chosen", "in_bag")


def members(spark, d, rects=None):
    """As ``sampled``, kept once, for what reads them several times."""
    return cut(sampled(spark, d, rects).drop("_sets"))


def train_sets(spark, d):
    nodes = trees.train_sets(sampled(spark, d), "price", ["discount", "tax"])
    return rounded(nodes.groupBy("set_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("feature").isNull()).alias("n_leaves")))


def predict_pixels(spark, d):
    """Statistics over the sets that cover each pixel; pixels without data take no part."""
    p = trees.predict_own(sampled(spark, d), "price", COLUMNS, which="complete")
    return p.groupBy("id").agg(half_even(F.avg("prediction")).alias("mean"), half_even(F.stddev_pop("prediction")).alias("stdv"), F.count("*").alias("n"))


def predict_combinations(spark, d):
    """As tree_predict_pixels, with the models of each distinct combination of sets shipped once."""
    m = members(spark, d)
    nodes = cut(trees.train_sets(m, "price", COLUMNS))
    whole = m.dropna(subset=COLUMNS)
    p = trees.predict_by_combination(whole.select("id", *COLUMNS).dropDuplicates(["id"]), whole.select("id", "set_id"), nodes, COLUMNS)
    mean = F.aggregate("predictions", F.lit(0.0), lambda s, v: s + v) / F.size("predictions")
    spread = F.sqrt(F.aggregate("predictions", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / F.size("predictions"))
    return p.withColumn("mean", mean).select("id", half_even(F.col("mean")).alias("mean"), half_even(spread).alias("stdv"), F.size("predictions").cast("bigint").alias("n"))


def predict_per_set(spark, d):
    """What each set predicts by itself; a set without a model has one row that says why."""
    return rounded(trees.summaries_of_sets(sampled(spark, d), "price", COLUMNS, least_rows=40), 4)


def oob(spark, d):
    return trees.oob_fit(trees.predict_own(sampled(spark, d), "ref", COLUMNS, kept=(), which="held"))


def with_class(df):
    """Observations with a class of four from their price."""
    return df.withColumn("label", F.least(F.floor(F.col("price") / 20000), F.lit(3)).cast("int"))


def class_oob(spark, d):
    p = trees.predict_own(with_class(sampled(spark, d)), "label", ["discount", "ref", "tax"], kept=(), which="held", classes=True)
    return rounded(trees.oob_agreement(p), 4)


def importance(spark, d):
    nodes = trees.train_sets(sampled(spark, d), "ref", COLUMNS)
    return rounded(trees.importance(nodes), 4)


def class_importance(spark, d):
    return trees.class_importance_own(with_class(sampled(spark, d)), "label", ["discount", "ref", "tax"])


def zero_inflated(spark, d):
    m = sampled(spark, d).withColumn("target", F.when(F.col("discount") < 0.03, 0.0).otherwise(F.floor(F.col("price") / 1000)))
    return rounded(trees.zero_inflated_own(m, "target", ["tax", "price"]).groupBy("id").agg(F.avg("prediction").alias("prediction")), 4)


#: Trees of the forest queries.
TREES = 50


def forest(how):
    def build(spark, d):
        rows = with_class(observations(spark, d))
        target, columns = ("label", ["discount", "ref", "tax"]) if how == "mode" else ("ref", COLUMNS)
        rows = cut(rows.select("id", target, *columns))
        nodes = forests.grow_forest(rows, target, columns, TREES, max_depth=4, max_features=2, classes=how == "mode")
        p = forests.predict_forest(rows.select("id", *columns), nodes, columns)
        if how == "mean":
            return p.select("id", half_even(F.aggregate("predictions", F.lit(0.0), lambda s, v: s + v) / F.size("predictions")).alias("prediction"))
        votes = F.transform(F.array_distinct("predictions"), lambda v: F.struct(F.size(F.filter("predictions", lambda w: w == v)).alias("n"), (-v).alias("least")))
        return p.select("id", (-F.array_max(votes)["least"]).cast("int").alias("prediction"))

    return build


def zero_inflated_forest(spark, d):
    """Means over pairs of trees, of which one says whether there is a value and the other what."""
    rows = cut(observations(spark, d).withColumn("target", F.when(F.col("discount") < 0.03, 0.0).otherwise(F.floor(F.col("price") / 1000))).select("id", "target", "tax", "price"))
    models = forests.grow_zero_inflated(rows, "target", ["tax", "price"], TREES)
    return rounded(forests.predict_zero_inflated(rows, models, ["tax", "price"], mean=True), 4)


def tree_count_sweep(spark, d):
    """Error out of bag by the number of trees."""
    rows = cut(observations(spark, d).select("id", "ref", *COLUMNS))
    nodes = forests.grow_forest(rows, "ref", COLUMNS, TREES, max_depth=4, max_features=2)
    p = forests.predict_forest(rows, nodes, COLUMNS, out_of_bag=0.63)
    return rounded(forests.error_by_trees(p, "ref", TREES), 4)


def support_size_sweep(spark, d):
    """Fit out of bag by the size of the support rectangles: half, whole and twice as wide and high."""
    sides = F.array(*[F.lit(k) for k in (0.5, 1.0, 2.0)])
    r = src.rectangles(spark, d).select("*", F.posexplode(sides).alias("k", "times"))
    grown = r.select((F.col("set_id") * 4 + F.col("k")).alias("set_id"), "ul_x", "ul_y", (F.col("ul_x") + F.col("times") * (F.col("lr_x") - F.col("ul_x"))).alias("lr_x"), (F.col("ul_y") - F.col("times") * (F.col("ul_y") - F.col("lr_y"))).alias("lr_y"))
    found = trees.oob_fit(trees.predict_own(sampled(spark, d, grown), "ref", COLUMNS, kept=(), which="held"))
    of = F.col("set_id") % 4
    return rounded(found.groupBy(F.get(sides, of.cast("int")).alias("times")).agg(F.count("*").alias("n_sets"), F.avg("oob_rate").alias("oob_rate"), F.avg("oob_rmse").alias("oob_rmse")), 4)


def hundredths(spark, d):
    return src.pixels(spark, d).select("row", "col", (F.col("value") / 1000).alias("value"))


def terrain(spark, d):
    return rounded(focal.slope_aspect(hundredths(spark, d), 30), 4)


def curvature(spark, d):
    return rounded(focal.curvature(hundredths(spark, d), 30), 6)


def strata_clamp(spark, d):
    sizes = src.pairs_in_order(spark, d).groupBy(F.floor(F.col("pred") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return rounded(sampling.clamped_sizes(sizes, "n", 50, 2000).select("bin", "size"), 4)


ROUND = "r{k} AS (SELECT bin, m * sum(s) OVER () / sum(m) OVER () AS s FROM (SELECT bin, s, CASE WHEN s < 50 THEN s + (50 - s) / 2.05 WHEN s > 2000 THEN s - (s - 2000) / 1.95 ELSE s END AS m FROM r{j}))"
CLAMP = ", r0 AS (SELECT CAST(pred // 10 AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS s FROM pair GROUP BY 1), " + ", ".join(ROUND.format(k=k, j=k - 1) for k in range(1, 11)) + " SELECT bin, round(s, 4) AS size FROM r10"
KERNEL = """, r AS (SELECT "row", col, value / 1000 AS v FROM px), z AS (SELECT a."row", a.col, """ + ", ".join(f"max(b.v) FILTER (WHERE b.\"row\" - a.\"row\" = {i} AND b.col - a.col = {j}) AS z{(i + 1) * 3 + j + 2}" for i in (-1, 0, 1) for j in (-1, 0, 1)) + """, count(b.v) AS n
  FROM r a JOIN r b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL),
  g AS (SELECT *, (z3 + 2 * z6 + z9 - z1 - 2 * z4 - z7) / 240 AS dx, (z7 + 2 * z8 + z9 - z1 - 2 * z2 - z3) / 240 AS dy FROM z WHERE n = 9)"""

ALL = {
    "tree_train_sets": (train_sets, None),
    "tree_predict_pixels": (predict_pixels, None),
    "tree_predict_combinations": (predict_combinations, None),
    "tree_predict_per_set": (predict_per_set, None),
    "tree_oob_metrics": (oob, None),
    "tree_class_oob": (class_oob, None),
    "tree_importance": (importance, None),
    "tree_class_importance": (class_importance, None),
    "zero_inflated_predict": (zero_inflated, None),
    "forest_predict_mean": (forest("mean"), None),
    "forest_predict_mode": (forest("mode"), None),
    "zero_inflated_forest": (zero_inflated_forest, None),
    "tree_count_sweep": (tree_count_sweep, None),
    "support_size_sweep": (support_size_sweep, None),
    "terrain_slope_aspect": (terrain, src.sql("px", body=KERNEL + ' SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS slope, round(((450 - degrees(atan2(dy, -dx))) % 360 + 360) % 360, 4) AS aspect FROM g')),
    "terrain_curvature": (curvature, src.sql("px", body=KERNEL + ' SELECT "row", col, round(-200 * (((z4 + z6) / 2 - z5) / 900 + ((z2 + z8) / 2 - z5) / 900), 6) AS curvature FROM g')),
    "strata_clamp": (strata_clamp, src.sql("pair", body=CLAMP)),
}
