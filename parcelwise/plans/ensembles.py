"""Queries on ensemble, zonal and focal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import gaussian_weight, half_even
from ..operators import accuracy, ensemble, focal
from ..sources import tables as src
from .common import rounded

sql = src.sql
COLUMNS = ["l_discount", "l_quantity", "l_tax"]


def ensemble_stats(spark, d):
    return ensemble.statistics(src.votes(spark, d), ["id"], "vote", ["mean", "median", "stdv", "count", "vote", "range"])


def pct_vote(spark, d):
    return ensemble.percent_vote(src.votes(spark, d), "id", "vote")


def gaussian_mean(spark, d):
    return ensemble.weighted_mean(src.votes(spark, d, placed=True), "id", "vote", gaussian_weight(F.col("vote"), 25, 5, 2.0), src.ORDER)


def importance_table(spark, d):
    li = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), (F.col("l_discount") * 10).alias("l_discount"), (F.col("l_quantity") / 50).alias("l_quantity"), (F.col("l_tax") * 12).alias("l_tax"))
    return li.groupBy("set_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in COLUMNS])


def importance_vote(spark, d):
    best = ensemble.greatest_variable(importance_table(spark, d), "set_id", COLUMNS)
    votes = src.votes(spark, d).select("id", "set_id").distinct().join(best, "set_id").withColumn("k", F.array_position(F.array(*[F.lit(c) for c in COLUMNS]), F.col("variable")).cast("int"))
    return votes.groupBy("id").agg(F.mode("k", True).alias("importance"))


def importance_rank(spark, d):
    long = ensemble.unpivoted(importance_table(spark, d), ["set_id"], COLUMNS).groupBy("variable").agg(F.round(F.avg("value"), 6).alias("mean"))
    return ensemble.ranked(long, "mean", "variable")


def importance_map(spark, d):
    whole = importance_table(spark, d).select("set_id", *[F.floor(100 * F.col(c)).cast("int").alias(c) for c in COLUMNS])
    each = src.votes(spark, d).select("id", "set_id").distinct().join(whole, "set_id").groupBy("id").agg(*[half_even(F.avg(c)).alias(c) for c in COLUMNS])
    return each.unpivot(["id"], COLUMNS, "variable", "importance")


def oob_map(spark, d):
    v = src.votes(spark, d)
    rate = v.groupBy("set_id").agg(F.avg("vote").cast("int").alias("rate"))
    return v.select("id", "set_id").distinct().join(rate, "set_id").groupBy("id").agg(half_even(F.avg("rate")).alias("oob"), F.count("*").alias("n_sets"))


def distinct_set_combos(spark, d):
    members = src.votes(spark, d).select("id", "set_id").distinct()
    return ensemble.covering_sets(members, "id", "set_id").groupBy("sets").agg(F.count("*").alias("n_pixels"), F.min("id").alias("first_id"))


def zonal_stats(spark, d):
    p = src.pixels(spark, d)
    named = {"mean": F.avg("value"), "least": F.min("value"), "most": F.max("value"), "stdv": F.stddev_pop("value"), "n": F.count("*")}
    return rounded(ensemble.zonal(p, "priority", named).join(accuracy.quantiles(p, ["priority"], "value", {"median": 0.5}), "priority"), 4)


def histogram_1d(spark, d):
    return ensemble.histogram(src.pairs_in_order(spark, d), "pred", 0, 100, 20)


def histogram_by_class(spark, d):
    return ensemble.histogram(src.pairs(spark, d), "ref", 0, 100, 10, ["priority"])


def histogram_2d(spark, d):
    return src.pairs_in_order(spark, d).groupBy(F.floor(F.col("ref") / 10).cast("int").alias("bx"), F.floor(F.col("pred") / 10).cast("int").alias("by")).agg(F.count("*").alias("n"))


def cdf_running(spark, d):
    return rounded(ensemble.running_share(ensemble.histogram(src.pairs_in_order(spark, d), "pred", 0, 100, 50), "bin", "n"))


def class_counts(spark, d):
    return src.pairs(spark, d).where("ref <> 0").groupBy(F.col("ref").alias("class")).agg(F.count("*").alias("n"))


def global_minmax(spark, d):
    return src.pairs_in_order(spark, d).agg(F.least(F.lit(50), F.min("pred")).alias("least"), F.greatest(F.lit(50), F.max("pred")).alias("most"))


def epoch_counts(spark, d):
    e = src.table(spark, d, "events")
    out = None
    for length in (3, 5):
        own = e.groupBy(F.floor(F.dayofmonth("ts") / length).cast("int").alias("epoch")).agg(F.count("*").alias("n")).where("epoch BETWEEN 1 AND 5").withColumn("epoch_len", F.lit(length))
        out = own if out is None else out.unionByName(own)
    return out


def model_inventory(spark, d):
    v = src.votes(spark, d)
    return v.groupBy("set_id").agg(F.count("*").alias("n_samples"), F.round(F.avg(F.when(F.col("vote") != 50, F.col("vote"))), 6).alias("avg_oob"), F.countDistinct("flag").alias("n_classes"))


def raster(spark, d):
    return src.pixels(spark, d).select("row", "col", (F.col("value") / 20000).cast("int").alias("value"), F.col("id"))


def square_mean(spark, d):
    r = raster(spark, d)
    return rounded(focal.focal(r, focal.square(3), "mean"))


def circle_mean(spark, d):
    r = raster(spark, d)
    return rounded(focal.focal(r, focal.circle(5), "mean"))


def focal_named(name):
    def build(spark, d):
        r = raster(spark, d)
        if name == "pct_nonzero":
            r = r.withColumn("value", F.col("value") % 3)
        if name == "uniform":
            r = r.withColumn("value", (F.col("value") > 12).cast("int"))
        return rounded(focal.focal(r, focal.square(3), name))

    return build


def samples(spark, d):
    return src.pairs_in_order(spark, d).where("sampled").select("row", "col", "pred")


def kernel_stats(spark, d):
    r = src.pixels(spark, d).withColumn("value", F.when(F.col("status") != "P", (F.col("value") / 100).cast("int")))
    return rounded(focal.kernel_statistics(r, samples(spark, d)))


def kernel_values(spark, d):
    return focal.kernel_columns(raster(spark, d), samples(spark, d), "v")


def best_match(spark, d):
    ref = src.pixels(spark, d).select("row", "col", F.when(F.col("status") != "P", (F.col("value") / 5000).cast("int")).alias("value"))
    return focal.best_match(samples(spark, d), ref)


def match_raster(spark, d):
    ref = src.pixels(spark, d).select("row", "col", (F.col("value") / 5000).cast("int").alias("value"))
    return focal.match_raster(src.pairs_in_order(spark, d).select("row", "col", F.col("pred").alias("value")), ref)


R = 'r AS (SELECT "row", col, CAST(trunc(value / 20000) AS INTEGER) AS value FROM px), z AS (SELECT max("row") + 1 AS h FROM px)'
NEAR = """n AS (SELECT a."row", a.col, a.value AS centre, b.value FROM r a CROSS JOIN z CROSS JOIN (SELECT i, j FROM range(-2, 3) x(i), range(-2, 3) y(j) WHERE {shape}) o
  JOIN r b ON b."row" = CASE WHEN a."row" + i < 0 THEN -(a."row" + i) - 1 WHEN a."row" + i >= h THEN 2 * h - 1 - (a."row" + i) ELSE a."row" + i END
  AND b.col = CASE WHEN a.col + j < 0 THEN -(a.col + j) - 1 WHEN a.col + j >= 100 THEN 199 - (a.col + j) ELSE a.col + j END)"""
SQUARE, CIRCLE = NEAR.format(shape="abs(i) <= 1 AND abs(j) <= 1"), NEAR.format(shape="i * i + j * j <= 4")
WINDOW = """w AS (SELECT s."row", s.col, s.pred, (i + 1) * 3 + j + 2 AS k, b.value FROM s CROSS JOIN range(-1, 2) x(i) CROSS JOIN range(-1, 2) y(j) LEFT JOIN r b ON b."row" = s."row" + i AND b.col = s.col + j)"""
BEST = "SELECT \"row\", col, pred, arg_min(value, (abs(value - pred), k)) AS matched FROM w WHERE value IS NOT NULL GROUP BY ALL"
IMP = "imp AS (SELECT l_suppkey AS set_id, round(avg(l_discount * 10), 6) AS l_discount, round(avg(l_quantity / 50), 6) AS l_quantity, round(avg(l_tax * 12), 6) AS l_tax FROM lineitem GROUP BY 1)"
LONG = "long AS (SELECT set_id, 'l_discount' AS variable, l_discount AS value FROM imp UNION ALL SELECT set_id, 'l_quantity', l_quantity FROM imp UNION ALL SELECT set_id, 'l_tax', l_tax FROM imp)"
MODE = "SELECT {by}, min({v}) FILTER (WHERE n = most) AS {out} FROM (SELECT {by}, {v}, count(*) AS n, max(count(*)) OVER (PARTITION BY {by}) AS most FROM {t} GROUP BY {by}, {v}) GROUP BY {by}"

ALL = {
    "ensemble_stats": (ensemble_stats, sql("votes", body=f""", m AS ({MODE.format(by="id", v="vote", out="vote", t="votes")})
      SELECT id, CAST(round_even(avg(v.vote), 0) AS INTEGER) AS mean, CAST(round_even(median(v.vote), 0) AS INTEGER) AS median, CAST(round_even(round(stddev_pop(v.vote), 6), 0) AS INTEGER) AS stdv, count(*) AS count, any_value(m.vote) AS vote, max(v.vote) - min(v.vote) AS range
      FROM votes v JOIN m USING (id) GROUP BY id""")),
    "pct_vote": (pct_vote, sql("votes", body=""", c AS (SELECT id, vote, count(*) AS n FROM votes GROUP BY ALL)
      SELECT id, arg_max(vote, (n, -vote)) AS vote, CAST(round_even(100 * max(n) / CAST(sum(n) AS DOUBLE), 0) AS INTEGER) AS pct_vote FROM c GROUP BY id""")),
    "gaussian_weighted_mean": (gaussian_mean, sql("votes", body="SELECT id, CAST(round_even(sum(pow(2.0 * exp(1.0), -pow(vote - 25, 2) / 50.0) * vote) / sum(pow(2.0 * exp(1.0), -pow(vote - 25, 2) / 50.0)), 0) AS INTEGER) AS weighted_mean FROM votes GROUP BY id")),
    "importance_vote": (importance_vote, sql("votes", body=f""", {IMP}, best AS (SELECT set_id, CAST(CASE WHEN l_discount >= l_quantity AND l_discount >= l_tax THEN 1 WHEN l_quantity >= l_tax THEN 2 ELSE 3 END AS INTEGER) AS k FROM imp),
      t AS (SELECT v.id, b.k FROM (SELECT DISTINCT id, set_id FROM votes) v JOIN best b USING (set_id)) {MODE.format(by="id", v="k", out="importance", t="t")}""")),
    "importance_rank": (importance_rank, f"WITH {IMP}, {LONG}, m AS (SELECT variable, round(avg(value), 6) AS mean FROM long GROUP BY variable) SELECT variable, mean, CAST(row_number() OVER (ORDER BY mean DESC, variable) AS INTEGER) AS rank FROM m"),
    "importance_map": (importance_map, sql("votes", body=f", {IMP}, {LONG} SELECT v.id, variable, CAST(round_even(avg(floor(100 * value)), 0) AS INTEGER) AS importance FROM (SELECT DISTINCT id, set_id FROM votes) v JOIN long USING (set_id) GROUP BY ALL")),
    "oob_map": (oob_map, sql("votes", body=", r AS (SELECT set_id, trunc(avg(vote)) AS rate FROM votes GROUP BY set_id) SELECT id, CAST(round_even(avg(rate), 0) AS INTEGER) AS oob, count(*) AS n_sets FROM (SELECT DISTINCT id, set_id FROM votes) JOIN r USING (set_id) GROUP BY id")),
    "distinct_set_combos": (distinct_set_combos, sql("votes", body=", c AS (SELECT id, string_agg(CAST(set_id AS VARCHAR), '_' ORDER BY set_id) AS sets FROM (SELECT DISTINCT id, set_id FROM votes) GROUP BY id) SELECT sets, count(*) AS n_pixels, min(id) AS first_id FROM c GROUP BY sets")),
    "zonal_stats": (zonal_stats, sql("px", body="SELECT priority, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS stdv, count(*) AS n FROM px GROUP BY priority")),
    "histogram_1d": (histogram_1d, sql("pair", body="SELECT CAST(least(floor(pred * 20 / 100.0), 19) AS INTEGER) AS bin, count(*) AS n FROM pair WHERE pred BETWEEN 0 AND 100 GROUP BY 1")),
    "histogram_by_class": (histogram_by_class, sql("pair", body="SELECT priority, CAST(least(floor(ref * 10 / 100.0), 9) AS INTEGER) AS bin, count(*) AS n FROM pair WHERE ref BETWEEN 0 AND 100 GROUP BY 1, 2")),
    "histogram_2d": (histogram_2d, sql("pair", body="SELECT CAST(ref // 10 AS INTEGER) AS bx, CAST(pred // 10 AS INTEGER) AS by, count(*) AS n FROM pair GROUP BY 1, 2")),
    "cdf_running": (cdf_running, sql("pair", body=""", h AS (SELECT CAST(least(floor(pred * 50 / 100.0), 49) AS INTEGER) AS bin, count(*) AS n FROM pair WHERE pred BETWEEN 0 AND 100 GROUP BY 1)
      SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY bin) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM h""")),
    "class_counts": (class_counts, sql("pair", body="SELECT ref AS class, count(*) AS n FROM pair WHERE ref <> 0 GROUP BY ref")),
    "global_minmax": (global_minmax, sql("pair", body="SELECT least(50, min(pred)) AS least, greatest(50, max(pred)) AS most FROM pair")),
    "epoch_counts": (epoch_counts, "SELECT CAST(day(ts) // l AS INTEGER) AS epoch, count(*) AS n, CAST(l AS INTEGER) AS epoch_len FROM events, (VALUES (3), (5)) t(l) WHERE day(ts) // l BETWEEN 1 AND 5 GROUP BY 1, 3"),
    "model_inventory": (model_inventory, sql("votes", body="SELECT set_id, count(*) AS n_samples, round(avg(vote) FILTER (WHERE vote <> 50), 6) AS avg_oob, count(DISTINCT flag) AS n_classes FROM votes GROUP BY set_id")),
    "focal_mean_square": (square_mean, sql("px", body=f', {R}, {SQUARE} SELECT "row", col, round(avg(value), 6) AS value FROM n GROUP BY ALL')),
    "focal_mean_circle": (circle_mean, sql("px", body=f', {R}, {CIRCLE} SELECT "row", col, round(avg(value), 6) AS value FROM n GROUP BY ALL')),
    "focal_mode": (focal_named("mode"), sql("px", body=f', {R}, {SQUARE} {MODE.format(by=chr(34) + "row" + chr(34) + ", col", v="value", out="value", t="n")}')),
    "focal_pct_nonzero": (focal_named("pct_nonzero"), sql("px", body=f', {R.replace("CAST(trunc(value / 20000) AS INTEGER)", "CAST(trunc(value / 20000) AS INTEGER) % 3")}, {SQUARE} SELECT "row", col, round(100 * count(*) FILTER (WHERE value <> 0) / CAST(count(*) AS DOUBLE), 6) AS value FROM n GROUP BY ALL')),
    "focal_uniform": (focal_named("uniform"), sql("px", body=f', {R.replace("CAST(trunc(value / 20000) AS INTEGER)", "CAST(trunc(value / 20000) > 12 AS INTEGER)")}, {SQUARE} SELECT "row", col, min(value) = max(value) AND min(value) = any_value(centre) AS value FROM n GROUP BY ALL')),
    "kernel_stats_3x3": (kernel_stats, sql("pair", body=f""", r AS (SELECT "row", col, CASE WHEN status <> 'P' THEN CAST(trunc(value / 100) AS INTEGER) END AS value FROM px), s AS (SELECT "row", col, pred FROM pair WHERE sampled), {WINDOW}
      SELECT "row", col, CAST(trunc(avg(value)) AS INTEGER) AS mean, round(median(value), 6) AS median, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stdv, max(value) - min(value) AS range FROM w GROUP BY ALL""")),
    "kernel_values_3x3": (kernel_values, sql("pair", body=f', {R}, s AS (SELECT "row", col, pred FROM pair WHERE sampled), {WINDOW} SELECT "row", col, ' + ", ".join(f"max(value) FILTER (WHERE k = {k}) AS v_{k}" for k in range(1, 10)) + " FROM w GROUP BY ALL")),
    "best_match_3x3": (best_match, sql("pair", body=f""", r AS (SELECT "row", col, CASE WHEN status <> 'P' THEN CAST(trunc(value / 5000) AS INTEGER) END AS value FROM px), s AS (SELECT "row", col, pred FROM pair WHERE sampled), {WINDOW} {BEST}""")),
    "match_raster": (match_raster, sql("pair", body=f', r AS (SELECT "row", col, CAST(trunc(value / 5000) AS INTEGER) AS value FROM px), s AS (SELECT "row", col, pred FROM pair), {WINDOW} {BEST}')),
}
