"""Queries on hash sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from ..sources import tables as src
from .common import rounded

sql = src.sql


def bootstrap(spark, d):
    v = src.votes(spark, d).select("set_id", "id").distinct()
    return sampling.fraction_of_groups(v, ["set_id"], "id", 0.63, 5).select("set_id", "id", F.col("chosen").alias("in_bag"))


def oob_rows(spark, d):
    b = bootstrap(spark, d)
    return b.join(b.where("in_bag").select("set_id", "id"), ["set_id", "id"], "left_anti").select("set_id", "id")


def train_test(spark, d):
    return src.pixels(spark, d).select("id", sampling.below("id", 0.8, 9).alias("train"))


def bins(spark, d):
    return src.pairs_in_order(spark, d).withColumn("bin", F.floor(F.col("pred") / 10).cast("int"))


def stratified(spark, d):
    return sampling.quota_sample(bins(spark, d), ["bin"], "id", F.lit(20), 2).select("bin", "id")


def zone_sample(spark, d):
    p = src.pixels(spark, d)
    zones = p.select(F.col("custkey")).distinct().where(sampling.below("custkey", 0.5, 4))
    return sampling.quota_sample(p.join(zones, "custkey", "left_semi"), ["custkey"], "id", F.lit(2), 6).select("custkey", "id")


def psu_bin_sample(spark, d):
    return sampling.quota_sample(bins(spark, d), ["tile_id", "bin"], "id", F.lit(3), 8).select("tile_id", "bin", "id")


def trial_locations(spark, d):
    p = src.pixels(spark, d).select("id", "tile_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial")).withColumn("key", F.col("id") * 5 + F.col("trial"))
    return sampling.quota_sample(p, ["trial", "tile_id"], "key", F.lit(2), 12).select("trial", "tile_id", "id")


def counts(spark, d):
    return bins(spark, d).groupBy("priority", "bin").agg(F.count("*").alias("n"))


def proportional(spark, d):
    return sampling.proportional_sizes(counts(spark, d), "priority", "n", 1000, 2.0)


def equal(spark, d):
    return sampling.equal_sizes(counts(spark, d), "priority", 1000, F.col("bin") == 0, 3.0)


def quota(spark, d):
    areas = src.pixels(spark, d).groupBy("priority").agg(F.count("*").alias("area"))
    return rounded(sampling.strata_quota(areas, "area", 37))


def test_pixels(spark, d):
    p = src.pixels(spark, d)
    train = p.where(sampling.below("id", 0.5, 1)).select("id")
    return sampling.quota_sample(p.join(train, "id", "left_anti"), ["status"], "id", F.lit(100), 3).select("status", "id")


def H(k, s):
    return f"((({k} * 2654435761 + {s} * 40503) % 4294967296) * 1597334677 + 12345) % 4294967296"


def quota_sql(table, by, key, n, seed, out):
    return f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {H(key, seed)}, {key}) AS rn FROM {table}) WHERE rn <= {n}"


BAG = f"b AS (SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY {H('id', 5)}, id) <= floor(0.63 * count(*) OVER (PARTITION BY set_id)) AS in_bag FROM (SELECT DISTINCT set_id, id FROM votes))"
BINS = "bins AS (SELECT *, CAST(pred // 10 AS INTEGER) AS bin FROM pair)"
COUNTS = f"{BINS}, c AS (SELECT priority, bin, count(*) AS n FROM bins GROUP BY ALL)"
TRIALS = "t AS (SELECT id, tile_id, CAST(k AS INTEGER) AS trial, id * 5 + k AS key FROM px, range(5) r(k))"

ALL = {
    "bootstrap_63": (bootstrap, sql("votes", body=f", {BAG} SELECT * FROM b")),
    "oob_rows": (oob_rows, sql("votes", body=f", {BAG} SELECT set_id, id FROM b WHERE NOT in_bag")),
    "train_test_split": (train_test, sql("px", body=f"SELECT id, {H('id', 9)} < {int(0.8 * 4294967296)} AS train FROM px")),
    "stratified_sample": (stratified, sql("pair", body=f", {BINS} " + quota_sql("bins", "bin", "id", 20, 2, "bin, id"))),
    "zone_sample": (zone_sample, sql("px", body=f", z AS (SELECT * FROM px WHERE {H('custkey', 4)} < 2147483648) " + quota_sql("z", "custkey", "id", 2, 6, "custkey, id"))),
    "psu_bin_sample": (psu_bin_sample, sql("pair", body=f", {BINS} " + quota_sql("bins", "tile_id, bin", "id", 3, 8, "tile_id, bin, id"))),
    "trial_locations": (trial_locations, sql("px", body=f", {TRIALS} " + quota_sql("t", "trial, tile_id", "key", 2, 12, "trial, tile_id, id"))),
    "strata_sizes_proportional": (proportional, sql("pair", body=f""", {COUNTS}, p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY priority) AS DOUBLE) AS p FROM c), m AS (SELECT *, (max(p) OVER (PARTITION BY priority) - min(p) OVER (PARTITION BY priority)) / 2 AS h FROM p),
      s AS (SELECT priority, bin, n, (p - h) / 2.0 + h AS s FROM m) SELECT priority, bin, n, CAST(round_even(s / sum(s) OVER (PARTITION BY priority) * 1000, 0) AS INTEGER) AS size FROM s""")),
    "strata_sizes_equal": (equal, sql("pair", body=f""", {COUNTS}, s AS (SELECT *, CASE WHEN bin = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM c) SELECT priority, bin, n, CAST(round_even(s / sum(s) OVER (PARTITION BY priority) * 1000, 0) AS INTEGER) AS size FROM s""")),
    "stratum_quota": (quota, sql("px", body=""", a AS (SELECT priority, count(*) AS area FROM px GROUP BY priority), s AS (SELECT *, area / CAST(sum(area) OVER () AS DOUBLE) AS share FROM a)
      SELECT priority, area, round(share, 6) AS share, greatest(1, CAST(round_even(share * 37, 0) AS INTEGER)) AS quota FROM s""")),
    "test_pixels": (test_pixels, sql("px", body=f", u AS (SELECT * FROM px WHERE NOT {H('id', 1)} < 2147483648) " + quota_sql("u", "status", "id", 100, 3, "status, id"))),
}
