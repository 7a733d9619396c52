"""Statistics over the predictions of overlapping sets, zones, histograms and rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even

#: Statistics of a group by name; rounded ones half to even.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": lambda v: half_even(F.avg(v)),
    "median": lambda v: half_even(F.median(v)),
    "stdv": lambda v: half_even(F.round(F.stddev_pop(v), 6)),
    "count": F.count,
    "vote": lambda v: F.mode(v, True),
    "range": lambda v: F.max(v) - F.min(v),
    "variance": F.var_pop,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}


def statistics(rows: DataFrame, by: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[STATISTICS[n](F.col(value)).alias(n) for n in names])


def percent_vote(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, vote, pct_vote): the smallest of the most frequent values, and its share in percent."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("vote"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return out.select(by, "vote", half_even(100 * F.col("most") / F.col("total")).alias("pct_vote"))


def added_in_order(rows: DataFrame, by: str, order: Sequence[str], named: dict[str, Column]) -> DataFrame:
    """Any named statistics of each group, whose rows are added one after another in a given order.

    Sums of doubles follow it, which decides where one that should lie on a half or a whole number is rounded to. So a
    group's rows are sorted in one task, where they spill if they are many.
    """
    w = Window.partitionBy(by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(by, *[c.over(so_far).alias(n) for n, c in named.items()], F.lead(F.lit(True)).over(w).alias("_more"))
    return running.where("_more IS NULL").drop("_more")


def weighted_mean(rows: DataFrame, by: str, value: str, weight: Column, order: Sequence[str] = ()) -> DataFrame:
    """(by, weighted_mean), half to even; the rows of a group are added in ``order`` if one is given."""
    held = rows.where(F.col(value).isNotNull())
    sums = {"_sum": F.sum(weight * F.col(value)), "_weight": F.sum(weight)}
    found = added_in_order(held, by, order, sums) if order else zonal(held, by, sums)
    return found.select(by, half_even(F.col("_sum") / F.col("_weight")).alias("weighted_mean"))


def unpivoted(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(columns), "variable", "value")


def greatest_variable(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, variable): the column of the greatest value, the first by name on a tie."""
    ordered = sorted(columns)
    long = unpivoted(rows, [key], ordered).withColumn("rank", F.array_position(F.array(*[F.lit(c) for c in ordered]), F.col("variable")))
    return long.groupBy(key).agg(F.max_by("variable", F.struct("value", -F.col("rank"))).alias("variable"))


def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rank from 1 by falling value, ties by name; for short lists such as one row a variable."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), name)))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n) of equal bins [low, high), the last one closed; values outside don't count."""
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    number = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*by, number.alias("bin")).agg(F.count("*").alias("n"))


def running_share(counts: DataFrame, order: str, n: str) -> DataFrame:
    """Running sum and its share of the total over a histogram's rows."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("running", F.sum(n).over(so_far)).withColumn("share", F.col("running") / F.sum(n).over(Window.partitionBy()))


def zonal(rows: DataFrame, zone: str, named: dict[str, Column]) -> DataFrame:
    """Any named statistics of each zone."""
    return rows.groupBy(zone).agg(*[c.alias(n) for n, c in named.items()])


def covering_sets(members: DataFrame, pixel: str, set_id: str) -> DataFrame:
    """(pixel, sets, n_sets): the sets that cover each pixel in order, and the number that equal combinations share."""
    each = members.groupBy(pixel).agg(F.array_sort(F.collect_set(set_id)).alias("sets"))
    return each.select(pixel, F.concat_ws("_", F.transform("sets", lambda s: s.cast("string"))).alias("sets"), F.size("sets").alias("n_sets"))


def prefixed(zones: DataFrame, zone: str, source: str) -> DataFrame:
    """Statistics of zones with their columns named after the source they come from."""
    return zones.select(zone, *[F.col(c).alias(f"{source}_{c}") for c in zones.columns if c != zone])


def numbered_combinations(members: DataFrame, pixel: str, set_id: str) -> tuple[DataFrame, DataFrame]:
    """(combo, sets, n_pixels) of the distinct combinations of covering sets, and (pixel, combo) that leads each pixel to its own.

    A combination's number is its least pixel, so both tables come without a window over all of them.
    """
    each = members.groupBy(pixel).agg(F.array_sort(F.collect_set(set_id)).alias("s"))
    each = each.select(pixel, F.concat_ws("_", F.transform("s", lambda x: x.cast("string"))).alias("sets"))
    combos = each.groupBy("sets").agg(F.min(pixel).alias("combo"), F.count("*").alias("n_pixels"))
    return combos, each.join(combos.select("sets", "combo"), "sets").select(pixel, "combo")


def hexagons(rows: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """(hx, hy, n): counts by hexagons, two lattices of rectangles whose centres lie ``size`` apart and half a step off; a point belongs to the nearer centre."""
    height = size * 3**0.5
    fx, fy = F.col(x) / size, F.col(y) / height
    a, b = F.round(fx), F.round(fy)
    c, d = F.floor(fx), F.floor(fy)
    from_a = F.pow(fx - a, F.lit(2)) + 3 * F.pow(fy - b, F.lit(2))
    from_c = F.pow(fx - c - 0.5, F.lit(2)) + 3 * F.pow(fy - d - 0.5, F.lit(2))
    first = from_a < from_c
    at = rows.select(F.when(first, a).otherwise(c + 0.5).alias("hx"), F.when(first, b).otherwise(d + 0.5).alias("hy"))
    return at.groupBy((F.col("hx") * size).alias("hx"), (F.col("hy") * height).alias("hy")).agg(F.count("*").alias("n"))


def cdf_at(counts: DataFrame, edge: str, n: str, edges: Sequence[int]) -> DataFrame:
    """(edge, share): the share of all that lies at or below each edge of a short list."""
    total = F.broadcast(counts.agg(F.sum(n).alias("total")))  # one row
    asked = counts.select(F.explode(F.array(*[F.lit(e) for e in edges])).alias("edge"), F.col(edge).alias("at"), F.col(n).alias("n"))
    return asked.groupBy("edge").agg(F.sum(F.when(F.col("at") <= F.col("edge"), F.col("n")).otherwise(0)).alias("upto")).crossJoin(total).select("edge", (F.col("upto") / F.col("total")).alias("share"))


def without_extreme(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, n_nodata, nodata, mean): statistics that leave out a run's nodata, taken to be its least value if that is negative, else its greatest."""
    ends = rows.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high")).select(by, F.when(F.col("low") < 0, F.col("low")).otherwise(F.col("high")).alias("nodata"))
    held = rows.join(ends, by)
    return held.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(value) == F.col("nodata")).alias("n_nodata"), F.first("nodata").alias("nodata"), F.avg(F.when(F.col(value) != F.col("nodata"), F.col(value))).alias("mean"))
