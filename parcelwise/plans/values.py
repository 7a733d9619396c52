"""Queries on scalar recoding, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import tables as src
from .common import rounded

sql = src.sql
#: Land-cover classes of an older legend and those of the present one.
LEGEND = {0: 0, 11: 7, 12: 9, 22: 18, 23: 16, 31: 27, 41: 36, 42: 38, 43: 46, 51: 48, 52: 56, 71: 67, 72: 78, 90: 87, 95: 92}


def reclassify(spark, d):
    return src.votes(spark, d).select("vote", scalars.recoded(F.col("vote"), LEGEND).alias("class")).distinct()


def reclassify_inverse(spark, d):
    return src.votes(spark, d).select("vote", scalars.recoded(F.col("vote"), LEGEND, inverse=True).alias("class")).distinct()


def epoch_year_recode(spark, d):
    e = src.table(spark, d, "events")
    epoch = F.floor(F.dayofmonth("ts") / 5).cast("int")
    return e.select("event_id", scalars.epoch_year(epoch, 5, 1985).cast("int").alias("year"))


def cosine_aspect(spark, d):
    p = src.pixels(spark, d)
    aspect = (F.col("id") % 360) + 0.5
    return p.select("id", scalars.cosine_aspect(aspect, 225).alias("ne_sw"), scalars.cosine_aspect(aspect, 135).alias("nw_se"))


def aspect_intensity(spark, d):
    p = src.pixels(spark, d)
    slope, aspect = (F.col("id") % 45).cast("double"), (F.col("id") % 360).cast("double")
    return rounded(p.select("id", scalars.aspect_intensity(slope, aspect, 0).alias("north"), scalars.aspect_intensity(slope, aspect, 180).alias("south")))


def scale_values(spark, d):
    return src.votes(spark, d).where("vote <> 50").select("id", (F.col("vote") * 10).cast("smallint").alias("scaled"))


def diff_map(spark, d):
    p = src.pairs_in_order(spark, d)
    return p.select("id", (F.when(F.col("status") != "P", F.col("pred")) - F.col("ref")).alias("difference"))


def pct_error(spark, d):
    return rounded(src.pairs_in_order(spark, d).select("id", scalars.percent_error(F.col("pred").cast("double"), F.col("ref").cast("double")).alias("pct")), 4)


def pathrow_ids(spark, d):
    c = src.table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("c_custkey"))
    return c.select("c_custkey", scalars.six_digits(F.col("c_custkey")).alias("six"), scalars.four_digits(F.col("c_custkey")).alias("four"))


def pathrow_expand(spark, d):
    s = src.table(spark, d, "supplier").select(F.concat(F.col("s_suppkey"), F.lit("-"), F.col("s_suppkey") + 2, F.lit("/"), F.lit(28), F.lit("-"), F.lit(30)).alias("range"))
    n = lambda k: F.regexp_extract("range", r"(\d+)-(\d+)/(\d+)-(\d+)", k).cast("int")
    return s.select("range", F.explode(F.sequence(n(1), n(2))).alias("path")).select("range", "path", F.explode(F.sequence(F.regexp_extract("range", r"/(\d+)-", 1).cast("int"), F.regexp_extract("range", r"/\d+-(\d+)", 1).cast("int"))).alias("at_row"))


def text_accuracy(spark, d):
    p = src.table(spark, d, "part")
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "error of ").otherwise("accuracy "), F.col("p_size").cast("string"), F.lit(" and 0."), F.col("p_size").cast("string"))
    return rounded(p.select("p_partkey", scalars.text_accuracy(text).alias("accuracy")), 4)


def row_metrics(spark, d):
    li = src.table(spark, d, "lineitem")
    cols = [F.when(F.col("l_quantity") > 5, F.col("l_quantity")), F.col("l_discount") * 100, F.col("l_tax") * 100]
    return rounded(li.select("l_orderkey", scalars.row_mean(cols).alias("mean"), F.greatest(*cols).alias("most"), F.least(*cols).alias("least"), sum(c.isNotNull().cast("int") for c in cols).alias("n_data"), sum(F.coalesce(scalars.in_bin(c, 2, 8), F.lit(False)).cast("int") for c in cols).alias("n_between")))


def bins(spark, d):
    edges = [(-1, 0)] + [(k, k + 10) for k in range(0, 100, 10)]
    return src.pairs_in_order(spark, d).select("id", scalars.bin_number(F.col("pred"), edges).alias("bin"))


def parse_bins(spark, d):
    text = F.concat_ws(",", F.concat(F.lit("-1:"), F.col("r_regionkey")), F.concat(F.col("r_regionkey"), F.lit(":"), F.col("r_regionkey") + 10))
    r = src.table(spark, d, "region").select("r_regionkey", F.posexplode(F.split(text, ",")).alias("k", "part"))
    return r.select("r_regionkey", F.col("k").cast("int").alias("k"), F.split("part", ":")[0].cast("int").alias("low"), F.split("part", ":")[1].cast("int").alias("high"))


def oob_drop_rule(spark, d):
    """Sets that a rule ``<metric> <op> <int>`` drops."""
    sets = src.votes(spark, d).groupBy("set_id").agg(F.avg("vote").cast("int").alias("rate"))
    return sets.where(~scalars.dropped(scalars.drop_rule("rate < 26", ["rate"])))


def dropped_rows(spark, d):
    li = src.votes(spark, d).withColumn("vote", F.when(F.col("vote") % 10 != 0, F.col("vote")))
    return li.groupBy(F.col("vote").isNull().alias("dropped")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


def finite_only(spark, d):
    p = src.pairs_in_order(spark, d).select("id", F.try_divide(F.col("ref").cast("double"), F.col("pred").cast("double")).alias("ratio"))
    return rounded(p.where(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") != float("inf"))))


def excluded_tiles(spark, d):
    return src.pixels(spark, d).where(~F.col("tile_id").isin(3, 16, 17, 18)).groupBy("tile_id").agg(F.count("*").alias("n"))


def min_samples(spark, d):
    return src.votes(spark, d).groupBy("set_id").agg(F.count("*").alias("n"), F.bool_or(F.isnan("price")).alias("has_nan")).where("n >= 25 AND NOT has_nan")


def valid_pixels(spark, d):
    v = src.votes(spark, d).select("id", F.when(F.col("vote") != 50, F.col("vote")).alias("a"), F.when(F.col("tax") > 0, F.col("tax")).alias("b"))
    return v.where("a IS NOT NULL AND b IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))


def union_samples(spark, d):
    p = src.pixels(spark, d)
    a, b = p.where("tile_id < 20").select("id", F.lit("a").alias("part"), "value"), p.where("tile_id >= 20").select("id", F.lit("b").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


def label_union(spark, d):
    return src.pairs_in_order(spark, d).select(F.explode(F.array("ref", "pred")).alias("label")).distinct()


def unmatched_labels(spark, d):
    p = src.pairs_in_order(spark, d)
    return p.select(F.col("ref").alias("label")).distinct().join(p.select((F.floor(F.col("pred") / 2) * 2).cast("int").alias("label")).distinct(), "label", "left_anti")


def matched_labels(spark, d):
    p = src.pairs_in_order(spark, d)
    return p.select(F.col("ref").alias("label")).intersect(p.select(F.col("pred").alias("label")))


def half_even(spark, d):
    return src.votes(spark, d).select("id", scalars.half_even(F.col("vote") / 2).alias("half")).groupBy("half").agg(F.count("*").alias("n"))


def feature_ring(spark, d):
    from ..operators.spatial import ring_of

    r = src.rectangles(spark, d)
    return r.select("set_id", F.posexplode(ring_of(F.col("ul_x"), F.col("ul_y"), F.col("lr_x"), F.col("lr_y"))).alias("k", "p")).select("set_id", F.col("k").cast("int").alias("k"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


CASES = " ".join(f"WHEN {a} THEN {b}" for a, b in LEGEND.items())
INVERSE = " ".join(f"WHEN {b} THEN {a}" for a, b in LEGEND.items())
M = "[CASE WHEN l_quantity > 5 THEN l_quantity END, l_discount * 100, l_tax * 100]"

ALL = {
    "reclassify": (reclassify, sql("votes", body=f"SELECT DISTINCT vote, CAST(CASE vote {CASES} ELSE vote END AS INTEGER) AS class FROM votes")),
    "reclassify_inverse": (reclassify_inverse, sql("votes", body=f"SELECT DISTINCT vote, CAST(CASE vote {INVERSE} ELSE vote END AS INTEGER) AS class FROM votes")),
    "epoch_year_recode": (epoch_year_recode, "SELECT event_id, CAST(CASE WHEN day(ts) // 5 <= 3 THEN 1988 + 5 * (day(ts) // 5) ELSE day(ts) // 5 END AS INTEGER) AS year FROM events"),
    "cosine_aspect": (cosine_aspect, sql("px", body="SELECT id, CAST(trunc(100 * (cos(radians(id % 360 - 225.0 + 0.5)) + 1)) AS SMALLINT) AS ne_sw, CAST(trunc(100 * (cos(radians(id % 360 - 135.0 + 0.5)) + 1)) AS SMALLINT) AS nw_se FROM px")),
    "aspect_intensity": (aspect_intensity, sql("px", body="SELECT id, round(sin((id % 45) / 57.29578) * cos((id % 360) / 57.29578), 6) AS north, round(sin((id % 45) / 57.29578) * cos((id % 360) / 57.29578 - 180), 6) AS south FROM px")),
    "scale_values": (scale_values, sql("votes", body="SELECT id, CAST(vote * 10 AS SMALLINT) AS scaled FROM votes WHERE vote <> 50")),
    "diff_map": (diff_map, sql("pair", body="SELECT id, CASE WHEN status <> 'P' THEN pred END - ref AS difference FROM pair")),
    "pct_error": (pct_error, sql("pair", body="SELECT id, round(CASE WHEN ref <> 0 THEN (pred - ref) / CAST(ref AS DOUBLE) * 100 END, 4) AS pct FROM pair")),
    "pathrow_ids": (pathrow_ids, "SELECT c_custkey, lpad(left(s, n), 3, '0') || lpad(substr(s, n + 1), 3, '0') AS six, right('0000' || s, 4) AS four FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s, CASE WHEN length(CAST(c_custkey AS VARCHAR)) = 5 THEN 3 ELSE 2 END AS n FROM (SELECT c_custkey + 1000 AS c_custkey FROM customer))"),
    "pathrow_expand": (pathrow_expand, "SELECT s_suppkey || '-' || (s_suppkey + 2) || '/28-30' AS range, CAST(s_suppkey + a AS INTEGER) AS path, CAST(28 + b AS INTEGER) AS at_row FROM supplier, range(3) x(a), range(3) y(b)"),
    "text_accuracy": (text_accuracy, """SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 100 - m ELSE m END, 4) AS accuracy FROM (SELECT p_partkey, p_size, (CASE WHEN CAST(p_size AS DOUBLE) < 1 THEN p_size * 100.0 ELSE CAST(p_size AS DOUBLE) END + CAST('0.' || p_size AS DOUBLE) * 100) / 2 AS m FROM part)"""),
    "row_metrics": (row_metrics, f"""SELECT l_orderkey, round(list_avg(list_filter(m, lambda x: x IS NOT NULL)), 6) AS mean, round(list_max(m), 6) AS most, round(list_min(m), 6) AS least, CAST(len(list_filter(m, lambda x: x IS NOT NULL)) AS INTEGER) AS n_data,
      CAST(len(list_filter(m, lambda x: x > 2 AND x <= 8)) AS INTEGER) AS n_between FROM (SELECT l_orderkey, {M} AS m FROM lineitem)"""),
    "bin_numbers": (bins, sql("pair", body="SELECT id, CAST(CASE WHEN pred > -1 AND pred <= 0 THEN 0 WHEN pred > 0 AND pred <= 100 THEN ceil(pred / 10.0) END AS INTEGER) AS bin FROM pair")),
    "parse_bins": (parse_bins, "SELECT r_regionkey, CAST(k AS INTEGER) AS k, CAST(CASE WHEN k = 0 THEN -1 ELSE r_regionkey END AS INTEGER) AS low, CAST(CASE WHEN k = 0 THEN r_regionkey ELSE r_regionkey + 10 END AS INTEGER) AS high FROM region, range(2) t(k)"),
    "oob_drop_rule": (oob_drop_rule, sql("votes", body="SELECT * FROM (SELECT set_id, CAST(trunc(avg(vote)) AS INTEGER) AS rate FROM votes GROUP BY set_id) WHERE NOT rate < 26")),
    "dropped_rows": (dropped_rows, sql("votes", body="SELECT vote % 10 = 0 AS dropped, count(*) AS n, round(sum(price), 2) AS price FROM votes GROUP BY 1")),
    "finite_only": (finite_only, sql("pair", body="SELECT id, round(ref / CAST(pred AS DOUBLE), 6) AS ratio FROM pair WHERE pred <> 0")),
    "excluded_tiles": (excluded_tiles, sql("px", body="SELECT tile_id, count(*) AS n FROM px WHERE tile_id NOT IN (3, 16, 17, 18) GROUP BY tile_id")),
    "min_samples": (min_samples, sql("votes", body="SELECT set_id, count(*) AS n, bool_or(isnan(price)) AS has_nan FROM votes GROUP BY set_id HAVING count(*) >= 25 AND NOT bool_or(isnan(price))")),
    "valid_pixels": (valid_pixels, sql("votes", body="SELECT id, count(*) AS n FROM votes WHERE vote <> 50 AND tax > 0 GROUP BY id")),
    "union_samples": (union_samples, sql("px", body="SELECT id, 'a' AS part, value FROM px WHERE tile_id < 20 UNION ALL SELECT id, 'b', NULL FROM px WHERE tile_id >= 20")),
    "label_union": (label_union, sql("pair", body="SELECT ref AS label FROM pair UNION SELECT pred FROM pair")),
    "unmatched_labels": (unmatched_labels, sql("pair", body="SELECT ref AS label FROM pair EXCEPT SELECT CAST(pred // 2 * 2 AS INTEGER) FROM pair")),
    "matched_labels": (matched_labels, sql("pair", body="SELECT ref AS label FROM pair INTERSECT SELECT pred FROM pair")),
    "half_even": (half_even, sql("votes", body="SELECT CAST(round_even(vote / 2.0, 0) AS INTEGER) AS half, count(*) AS n FROM votes GROUP BY 1")),
    "feature_ring": (feature_ring, sql("rect", body="SELECT set_id, CAST(k AS INTEGER) AS k, CAST(CASE WHEN k IN (1, 2) THEN lr_x ELSE ul_x END AS DOUBLE) AS x, CAST(CASE WHEN k IN (2, 3) THEN lr_y ELSE ul_y END AS DOUBLE) AS y FROM rect, range(5) t(k)")),
}
