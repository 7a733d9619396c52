"""Sampling by a hash of the key: the same rows on every run and in every engine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import portable_hash
from ..session import cut


def hash_order(key: str, seed: int) -> list[Column]:
    return [portable_hash(F.col(key), seed), F.col(key)]


def fraction_of_groups(rows: DataFrame, by: Sequence[str], key: str, fraction: float, seed: int) -> DataFrame:
    """``chosen``: whether a row is among the first int(fraction n) of its group in hash order."""
    group = Window.partitionBy(*by)
    return rows.withColumn("chosen", F.row_number().over(group.orderBy(*hash_order(key, seed))) <= F.floor(F.lit(fraction) * F.count("*").over(group)))


def below(key: str, fraction: float, seed: int) -> Column:
    """Whether a key's hash lies in the first ``fraction`` of its range: a sample without any shuffle."""
    return portable_hash(F.col(key), seed) < int(fraction * 4294967296)


#: Parts that a group's rows are ranked in before the first of each part are ranked together.
PARTS = 64


def first_of_groups(rows: DataFrame, by: Sequence[str], key: str, quota: Column, seed: int) -> DataFrame:
    """The first ``quota`` rows of each group in hash order with their number ``rn``; a group is cut to at most ``PARTS`` times its quota before its rows meet."""
    order = hash_order(key, seed)
    spread = F.pmod(F.xxhash64(key), F.lit(PARTS))
    some = rows.withColumn("_part", spread).withColumn("rn", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("rn") <= quota).drop("rn", "_part")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= quota)


def quota_sample(rows: DataFrame, by: Sequence[str], key: str, quota: Column, seed: int) -> DataFrame:
    """The first ``quota`` rows of each group in hash order, all where there are fewer."""
    return first_of_groups(rows, by, key, quota, seed).drop("rn")


def repeated_quota(rows: DataFrame, by: str, key: str, quota: int, trials: int, seed: int) -> DataFrame:
    """Rows with ``trial``: for each of so many trials the first ``quota`` rows of each group in the hash order of key * trials + trial; ``key`` holds whole numbers.

    Rows of a group lie together once; the first of each batch by trial are found in place, and these alone are
    repeated and ranked for the whole group.
    """
    from .forests import hashed

    kept = rows.columns

    def first(batches):
        for b in batches:
            number = b[key].to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.unique(b["_by"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
            for trial in range(trials):
                own = number * trials + trial
                order = np.lexsort((own, hashed(own, seed), group))
                begins = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
                place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
                picked = b.take(pa.array(order[place < quota]))
                yield pa.RecordBatch.from_arrays([*picked.columns[:-1], pa.array(np.full(picked.num_rows, trial, np.int32))], [*kept, "trial"])

    held = rows.where(F.col(key).isNotNull()).withColumn("_by", F.xxhash64(by)).repartition(by).sortWithinPartitions("_by")
    some = held.mapInArrow(first, rows.withColumn("trial", F.lit(0)).schema)
    number = F.col(key) * trials + F.col("trial")
    ranked = Window.partitionBy("trial", by).orderBy(portable_hash(number, seed), number)
    return some.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= quota).drop("_rn")


def proportional_sizes(counts: DataFrame, by: str, n: str, sample_size: int, scale: float) -> DataFrame:
    """Strata sizes in proportion to their counts, drawn toward mid-range by ``scale``; ``by`` names the table they add up in."""
    w = Window.partitionBy(by)
    p = F.col(n) / F.sum(n).over(w)
    rows = counts.withColumn("p", p)
    centre = (F.max("p").over(w) - F.min("p").over(w)) / 2
    rows = rows.withColumn("s", (F.col("p") - centre) / scale + centre)
    return rows.withColumn("size", F.bround(F.col("s") / F.sum("s").over(w) * sample_size, 0).cast("int")).drop("p", "s")


def equal_sizes(counts: DataFrame, by: str, sample_size: int, is_zero: Column, zero_inflation: float) -> DataFrame:
    """Equal strata sizes, that of the zero stratum inflated, adding up to the sample."""
    w = Window.partitionBy(by)
    rows = counts.withColumn("s", F.when(is_zero, F.lit(zero_inflation)).otherwise(F.lit(1.0)))
    return rows.withColumn("size", F.bround(F.col("s") / F.sum("s").over(w) * sample_size, 0).cast("int")).drop("s")


def strata_quota(areas: DataFrame, area: str, n: int) -> DataFrame:
    """Each stratum's share of the area and its quota of at least one; for one row a stratum."""
    share = F.col(area) / F.sum(area).over(Window.partitionBy())
    return areas.withColumn("share", share).withColumn("quota", F.greatest(F.lit(1), F.bround(share * n, 0).cast("int")))


def clamped_sizes(counts: DataFrame, n: str, low: float, high: float, rounds: int = 10) -> DataFrame:
    """``size``: strata sizes moved into [low, high] by damped rounds that keep their sum; for one row a stratum."""
    every = Window.partitionBy()
    rows = counts.withColumn("size", F.col(n).cast("double"))
    for _ in range(rounds):
        s = F.col("size")
        moved = rows.withColumn("moved", F.when(s < low, s + (low - s) / 2.05).when(s > high, s - (s - high) / 1.95).otherwise(s))
        rows = moved.withColumn("size", F.col("moved") * F.sum("size").over(every) / F.sum("moved").over(every)).drop("moved")
    return rows


def split_by_pairs(rows: DataFrame, keys: Sequence[str], fraction: float, seed: int, separately: bool = False) -> DataFrame:
    """``train``: whether a row's keys are among the first int(fraction n) distinct ones in hash order.

    ``separately``: whether each key by itself is among the chosen ones', which takes in more rows. The chosen number
    is found by a hash threshold's exact rank: distinct keys are ranked within ranges of the hash.
    """
    distinct = rows.select(*keys).distinct()
    number = F.col(keys[0]).cast("bigint") * 100_000 + F.col(keys[1])
    hashed = distinct.withColumn("h", portable_hash(number % 2147483647, seed) * 4096 + number % 4096)
    n = int(fraction * hashed.count())
    chosen = first_by(hashed, "h", n).select(*keys)
    if not separately:
        return rows.join(chosen.withColumn("train", F.lit(True)), list(keys), "left").withColumn("train", F.coalesce("train", F.lit(False)))
    out = rows
    for k in keys:
        out = out.join(chosen.select(k).distinct().withColumn(f"_{k}", F.lit(True)), k, "left")
    both = F.lit(True)
    for k in keys:
        both &= F.coalesce(F.col(f"_{k}"), F.lit(False))
    return out.withColumn("train", both).drop(*[f"_{k}" for k in keys])


def first_by(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    from .accuracy import sums_before

    numbered = sums_before(rows.withColumn("_one", F.lit(1)), order, ["_one"])
    return numbered.where(F.col("before__one") < n).drop("_one", "before__one")


def quota_split(rows: DataFrame, by: Sequence[str], key: str, quota: Column, fraction: float, seed: int) -> DataFrame:
    """The rows of ``quota_sample`` with ``train``: whether a row is among the first int(fraction n) taken of its group."""
    taken = first_of_groups(rows, by, key, quota, seed).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return taken.withColumn("train", F.col("rn") <= F.floor(F.col("_n") * fraction)).drop("rn", "_n")


def presence_absence(rows: DataFrame, zone: str, key: str, absent: Column, n: int, zone_fraction: float, sample_fraction: float, seed: int) -> DataFrame:
    """(key, zone, present, train): as many absent as present pixels, the zones of present ones split into train and test first.

    Absent pixels: the first n/2 in hash order, split by ``sample_fraction``. Present ones: of the training zones and of
    the others, each their share of n/2.
    """
    half = n // 2
    zones = rows.where(~absent).select(zone).distinct().withColumn("of_train", below(zone, zone_fraction, seed))
    pixels = rows.join(zones, zone, "left").withColumn("present", ~absent)
    side = F.when(~F.col("present"), F.lit("absent")).when(F.col("of_train"), F.lit("train")).otherwise(F.lit("test"))
    quota = F.when(F.col("side") == "absent", half).when(F.col("side") == "train", int(half * sample_fraction)).otherwise(int(half * (1 - sample_fraction)))
    out = quota_split(pixels.withColumn("side", side), ["side"], key, quota, sample_fraction, seed + 1)
    return out.select(key, zone, "present", F.when(F.col("side") == "absent", F.col("train")).otherwise(F.col("side") == "train").alias("train"))


def year_of(rows: DataFrame, by: Sequence[str], key: str, columns: Sequence[str], target: str, seed: int) -> DataFrame:
    """``target`` from one of several year columns, each for an equal share of the rows of a group, the last for what is left over."""
    group = Window.partitionBy(*by)
    n, each = len(columns), F.floor(F.count("*").over(group) / len(columns))
    rows = rows.withColumn("_k", F.least(F.floor((F.row_number().over(group.orderBy(*hash_order(key, seed))) - 1) / each), F.lit(n - 1)))
    value, year = F.lit(None), F.lit(None)
    for k, c in reversed(list(enumerate(columns))):
        value, year = F.when(F.col("_k") == k, F.col(c)).otherwise(value), F.when(F.col("_k") == k, F.lit(c)).otherwise(year)
    return rows.withColumns({target: value, "source": year}).drop("_k")


def apart(candidates: DataFrame, quota: DataFrame, stratum: str, key: str, distance: float, seed: int) -> DataFrame:
    """Candidates (key, stratum, x, y) picked up to each stratum's ``quota`` so that no two picked ones lie within ``distance``, at most.

    Every candidate has a place in one order of all, by a hash of its key. A round picks those that no earlier open
    candidate within reach or of the same full stratum precedes, and closes all within reach of them. So strata take
    turns by chance, as candidates do; rounds follow the longest run of neighbours in that order, not the number of
    candidates. Neighbours meet on cells as wide as the distance. A stratum runs short where its candidates are taken up.
    """
    spaced = Window.partitionBy(stratum).orderBy("place", key)
    rows = candidates.withColumn("place", portable_hash(F.col(key), seed))
    cell = lambda c: F.floor(F.col(c) / distance)
    placed = rows.withColumns({"cx": cell("x"), "cy": cell("y")})
    around = placed.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"), F.col(key).alias("other"), F.col("place").alias("other_place"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx")).alias("bx"), F.col("cy").alias("by"))
    around = around.select("other", "other_place", "ox", "oy", (F.col("bx") + F.col("o.i")).alias("cx"), (F.col("by") + F.col("o.j")).alias("cy"))
    near = placed.join(around, ["cx", "cy"]).where((F.col(key) != F.col("other")) & (F.sqrt(F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2))) <= distance))
    links = cut(near.select(key, "other", F.struct("other_place", "other").alias("other_at")))
    state = cut(rows.withColumn("state", F.lit("open")))
    while True:
        left = quota.join(state.where("state = 'picked'").groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left").select(stratum, (F.col("quota") - F.coalesce("n", F.lit(0))).alias("left"))
        open_rows = state.where("state = 'open'").join(left, stratum).withColumn("rn", F.row_number().over(spaced))
        if open_rows.where("left > 0").isEmpty():
            return state.where("state = 'picked'").drop("state", "place")
        # those beyond what a stratum may still take wait for the ones before them
        first = open_rows.where(F.col("rn") <= F.col("left"))
        waiting = links.join(open_rows.where("left > 0").select(F.col(key).alias("other")), "other").groupBy(key).agg(F.min("other_at").alias("least"))
        picked = first.join(waiting, key, "left").where(F.col("least").isNull() | (F.struct(F.col("place").alias("other_place"), F.col(key).alias("other")) < F.col("least"))).select(key).withColumn("is_picked", F.lit(True))
        closed = links.join(picked.select(F.col(key).alias("other")), "other").select(key).distinct().withColumn("is_closed", F.lit(True))
        full = left.where("left <= 0").select(stratum).withColumn("is_full", F.lit(True))
        told = state.join(picked, key, "left").join(closed, key, "left").join(full, stratum, "left")
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("is_picked"), F.lit("picked")).when(F.col("is_closed") | F.col("is_full"), F.lit("closed")).otherwise(F.lit("open"))
        state = cut(told.withColumn("state", now).select(*state.columns))


def picked_by_strata(places: DataFrame, serves: DataFrame, quota: DataFrame, stratum: str, key: str, distance: float, seed: int) -> DataFrame:
    """(key, stratum, x, y): places picked for strata that share them, as if strata took their turn one after another.

    ``places`` (key, x, y); ``serves`` the pairs (key, stratum) of a place and a stratum that it may be picked for, any
    number for each place; ``quota`` (stratum, quota). Strata come in an order drawn by a hash, and within each its places in
    the order of a hash; a place is picked if its stratum isn't full and no place picked before it, for whatever
    stratum, lies within ``distance``. The result is that of the plain loop over strata and places. It is found in
    rounds: a pair that precedes all open pairs within its reach, and that its stratum has room for whatever becomes of
    the pairs before it, is picked, and closes what lies within reach. Rounds follow the longest run of neighbours in the
    order. Neighbours meet on cells as wide as the distance; the links are between places, not pairs.
    """
    cell = lambda c: F.floor(F.col(c) / distance)
    placed = places.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"cx": cell("x"), "cy": cell("y")})
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = placed.select(F.col(key).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("bx"), F.col("cy").alias("by"), beside.alias("o"))
    around = around.select("other", "ox", "oy", (F.col("bx") + F.col("o.i")).alias("cx"), (F.col("by") + F.col("o.j")).alias("cy"))
    apart = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    links = cut(placed.join(around, ["cx", "cy"]).where(apart <= distance).select(key, "other"))  # each with itself too
    turn = F.struct(portable_hash(F.crc32(F.col(stratum).cast("string").cast("binary")), seed).alias("drawn"), F.col(stratum).alias("name"), portable_hash(F.col(key), seed).alias("place"), F.col(key).alias("of"))
    state = cut(serves.select(key, stratum).distinct().join(placed.select(key), key, "left_semi").withColumns({"turn": turn, "state": F.lit("open")}))
    while True:
        taken = state.where("state = 'picked'").groupBy(stratum).agg(F.count("*").alias("n"))
        left = quota.join(taken, stratum, "left").select(stratum, (F.col("quota") - F.coalesce("n", F.lit(0))).alias("left"))
        waiting = cut(state.where("state = 'open'").join(left.where("left > 0"), stratum))
        if waiting.isEmpty():
            return state.where("state = 'picked'").select(key, stratum).join(places.select(key, "x", "y"), key)
        first = waiting.groupBy(F.col(key).alias("other")).agg(F.min("turn").alias("turn"))
        least = links.join(first, "other").groupBy(key).agg(F.min("turn").alias("least"))
        ranked = waiting.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy("turn")))
        picked = cut(ranked.where("rn <= left").join(least, key).where("turn = least").select(key, stratum))
        closed = links.join(picked.select(F.col(key).alias("other")), "other").select(key).distinct().withColumn("closed", F.lit(True))
        told = state.join(picked.withColumn("picked", F.lit(True)), [key, stratum], "left").join(closed, key, "left")
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("picked"), F.lit("picked")).when(F.col("closed"), F.lit("closed")).otherwise(F.lit("open"))
        state = cut(told.select(key, stratum, "turn", now.alias("state")))
