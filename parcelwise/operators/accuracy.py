"""Accuracy assessment: error families, agreement, confusion matrices adjusted by area, intervals, ranks and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: z of 95 percent.
Z = 1.96


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where a series is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def errors(rows: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    d = F.col(pred) - F.col(ref)
    means = rows.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (100 * F.sqrt(F.avg(F.pow(d / F.when(F.col(ref) != 0, F.col(ref)), F.lit(2))))).alias("rmspe"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("bias"),
        F.count("*").alias("n"),
    )
    middle = quantiles(rows.select(*by, F.abs(d).alias("_d")), by, "_d", {"mae_median": 0.5})
    return means.join(middle, by) if by else means.crossJoin(F.broadcast(middle))  # one row each


def agreement(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement coefficient with its systematic and unsystematic parts, null where a series is constant or r is 0.

    Two aggregations: means, correlation and sums of squares, then sums of distances from them. Groups take one row
    each between the two, so only that small table is joined back.
    """
    by = list(by)
    key = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    means = held.groupBy(*key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), correlation("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    b = F.when((F.col("vx") > 0) & (F.col("r") != 0), F.signum("r") * F.sqrt(F.col("vy") / F.when(F.col("vx") > 0, F.col("vx"))))
    fitted = means.withColumn("b", F.when(b != 0, b)).withColumn("a", F.col("my") - F.col("b") * F.col("mx"))
    d = F.abs(F.col("mx") - F.col("my"))
    gx, gy = (F.col("y") - F.col("a")) / F.col("b"), F.col("a") + F.col("b") * F.col("x")
    sums = held.join(fitted, key).groupBy(*key).agg(
        F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2))).alias("ssd"),
        F.sum((d + F.abs(F.col("x") - F.col("mx"))) * (d + F.abs(F.col("y") - F.col("my")))).alias("spod"),
        F.sum(F.abs(F.col("x") - gx) * F.abs(F.col("y") - gy)).alias("spdu"),
        F.count("*").alias("n"),
    )
    spod = F.when((F.col("spod") != 0) & F.col("spdu").isNotNull(), F.col("spod"))
    return sums.select(*by, (1 - F.col("ssd") / spod).alias("ac"), (1 - (F.col("ssd") - F.col("spdu")) / spod).alias("ac_sys"), (1 - F.col("spdu") / spod).alias("ac_unsys"), "n")


def counts(rows: DataFrame, pred: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """(pred, ref, n) of a confusion matrix in long form."""
    return rows.groupBy(*by, F.col(pred).alias("pred"), F.col(ref).alias("ref")).agg(F.count("*").alias("n"))


def by_area(rows: DataFrame, pred: str, ref: str, sampled: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, pred, ref, n, n_pred, total_pxl, pct_area, adj): sample counts, and their share of the map by the area of the predicted class.

    ``rows`` are the map's pixels, ``sampled`` whether one is in the sample. A class that no sample predicts leaves both
    axes: its reference samples count nowhere. All pairs of the classes left have a row. Pixels are counted once, for
    both the map and the sample; what follows has a row for each pair of classes, few whatever the map.
    """
    by = list(by)
    return _adjusted(rows.groupBy(*by, F.col(pred).alias("pred"), F.col(ref).alias("ref")).agg(F.count("*").alias("every"), F.count_if(sampled).alias("n")), by)


def _adjusted(each: DataFrame, by: list[str]) -> DataFrame:
    """The matrix of counts (by, pred, ref, every, n) of the map's pixels and of samples."""
    area = each.groupBy(*by, "pred").agg(F.sum("every").alias("total_pxl"), F.sum("n").alias("held"))
    area = area.withColumn("pct_area", F.col("total_pxl") / F.sum("total_pxl").over(Window.partitionBy(*by)))
    area = area.where("held > 0 AND pred IS NOT NULL").drop("held")
    axis = area.select(*by, F.col("pred").alias("ref"))
    grid = area.join(axis, by) if by else area.crossJoin(F.broadcast(axis))  # one row a class
    cells = grid.join(each.select(*by, "pred", "ref", "n"), [*by, "pred", "ref"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = cells.withColumn("n_pred", F.sum("n").over(Window.partitionBy(*by, "pred")))
    return cells.select(*by, "pred", "ref", "n", "total_pxl", "pct_area", "n_pred", (F.try_divide("n", "n_pred") * F.col("pct_area")).alias("adj"))


def equal_edges(rows: DataFrame, ref: str, bins: int) -> list[tuple[int, int]]:
    """The bins (low, high] of a matrix that is asked for by a number of classes alone: one for zero and below, then steps from 0 on as wide as the reference's range over ``bins``, whole numbers, up to that range."""
    low, high = rows.agg(F.min(ref), F.max(ref)).first()  # one row
    if low is None or (step := int(high - low) // bins) < 1:
        raise ValueError(f"{ref} spans too little for {bins} bins")
    return [(-1, 0)] + [(k, k + step) for k in range(0, int(high - low), step)]


def with_matches(rows: DataFrame, pred: str, ref: str, sampled: str, best: bool = True) -> DataFrame:
    """``rows`` (row, col, ...) with the sample's values matched to their surroundings, three by three, before they are binned.

    ``best``: a sampled reference becomes the one around it nearest to the prediction, the first row by row on a tie.
    Otherwise both become the mean around them, cut to whole numbers. The map's own pixels stay as they are, so the areas
    do; the matched values are in ``sample_pred`` and ``sample_ref``, null for pixels that aren't in the sample.
    """
    from .focal import best_match, neighbours_of

    samples = rows.where(F.col(sampled)).select("row", "col", F.col(pred).alias("pred")).distinct()
    of = lambda c: rows.where(F.col(c).isNotNull()).select("row", "col", F.col(c).alias("value"))
    if best:
        matched = best_match(samples, of(ref)).select("row", "col", F.col("pred").alias("sample_pred"), F.col("matched").alias("sample_ref"))
    else:
        mean = lambda c, name: neighbours_of(samples, of(c)).groupBy("row", "col").agg(F.avg("value").cast("int").alias(name))
        matched = mean(pred, "sample_pred").join(mean(ref, "sample_ref"), ["row", "col"])
    return rows.join(matched, ["row", "col"], "left")


def by_area_of(rows: DataFrame, samples: DataFrame, pred: str, ref: str) -> DataFrame:
    """``by_area`` of a map (pred) and of samples (pred, ref) that need not be its pixels."""
    both = rows.select(F.col(pred).alias("pred"), F.lit(None).cast("int").alias("ref"), F.lit(True).alias("of_map")).unionByName(samples.select(F.col(pred).alias("pred"), F.col(ref).alias("ref"), F.lit(False).alias("of_map")))
    cells = both.groupBy("pred", "ref").agg(F.count_if("of_map").alias("every"), F.count_if(~F.col("of_map")).alias("n"))
    return _adjusted(cells, [])


def with_empty_classes(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """A matrix with a row for each pair of ``classes`` (class), null where ``by_area`` left a class out."""
    every = classes.select(F.col("class").alias("pred")).crossJoin(F.broadcast(classes.select(F.col("class").alias("ref"))))  # one row a class
    return every.join(matrix, ["pred", "ref"], "left")


def by_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, n, total_pxl, pct_area, user, user_ci, producer, producer_ci) from ``by_area``; intervals need two samples of a class."""
    by = list(by)
    same = F.col("pred") == F.col("ref")
    rows = matrix.groupBy(*by, F.col("pred").alias("class")).agg(F.first("n_pred").alias("n"), F.first("total_pxl").alias("total_pxl"), F.first("pct_area").alias("pct_area"), F.sum(F.when(same, F.col("n"))).alias("hit"))
    q = matrix.withColumn("q", F.try_divide("n", "n_pred"))
    spread = F.pow("total_pxl", F.lit(2)) * F.col("q") * (1 - F.col("q")) / F.when(F.col("n_pred") > 1, F.col("n_pred") - 1)
    columns = q.groupBy(*by, F.col("ref").alias("class")).agg(F.sum("adj").alias("col"), F.sum(F.when(same, F.col("adj"))).alias("diag"), F.sum(F.col("total_pxl") * F.col("q")).alias("estimated"), F.sum(F.when(~same, spread)).alias("others"))
    rows = rows.join(columns, [*by, "class"], "left").withColumns({"user": F.try_divide("hit", "n"), "producer": F.try_divide("diag", "col")})
    more = F.when(F.col("n") > 1, F.col("n") - 1)
    u, p = F.col("user"), F.col("producer")
    variance = (F.pow("total_pxl", F.lit(2)) * F.pow(1 - p, F.lit(2)) * u * (1 - u) / more + F.pow(p, F.lit(2)) * F.coalesce("others", F.lit(0.0))) / F.pow("estimated", F.lit(2))
    return rows.select(*by, "class", "n", "total_pxl", "pct_area", u.alias("user"), (Z * F.sqrt(u * (1 - u) / more)).alias("user_ci"), p.alias("producer"), (Z * F.sqrt(variance)).alias("producer_ci"))


def in_percent(share: Column) -> Column:
    """A share as reports state it: rounded to three digits, times 100."""
    return F.round(F.round(share, 3) * 100, 1)


def overall(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each of ``by``): accuracy, its interval, kappa (expected agreement from sample margins), quantity and allocation disagreement."""
    by = list(by)
    same = F.col("pred") == F.col("ref")
    users = matrix.groupBy(*by, F.col("pred").alias("class")).agg(F.first("n_pred").alias("n_row"), F.first("pct_area").alias("w"), F.sum(F.when(same, F.col("n"))).alias("hit"), F.coalesce(F.sum(F.when(same, F.col("adj"))), F.lit(0.0)).alias("diag"))
    columns = matrix.groupBy(*by, F.col("ref").alias("class")).agg(F.sum("n").alias("n_col"))
    both = users.join(columns, [*by, "class"])
    row, col, hit = F.col("n_row"), F.col("n_col"), F.col("hit")
    u = F.try_divide("hit", "n_row")
    out = both.groupBy(*by).agg(
        F.sum("diag").alias("accuracy"),
        (Z * F.sqrt(F.sum(F.pow("w", F.lit(2)) * u * (1 - u) / F.when(row > 1, row - 1)))).alias("accuracy_ci"),
        F.try_divide(F.sum(row * col), F.pow(F.sum(row), F.lit(2))).alias("expected"),
        (F.sum(F.abs(row - col)) / 2).alias("quantity"),
        F.sum(F.least(row - hit, col - hit)).cast("double").alias("allocation"),
    )
    return out.withColumn("kappa", F.try_divide(F.col("accuracy") - F.col("expected"), 1 - F.col("expected")))


def plain(rows: DataFrame, pred: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """(class, n_pred, n_ref, hits, user, producer, commission, omission, f1) from raw counts."""
    long = rows.select(*by, F.explode(F.array(F.struct(F.col(pred).alias("class"), F.lit(1).alias("p"), F.lit(0).alias("r"), (F.col(pred) == F.col(ref)).cast("int").alias("h")), F.struct(F.col(ref).alias("class"), F.lit(0).alias("p"), F.lit(1).alias("r"), F.lit(0).alias("h")))).alias("s"))
    out = long.groupBy(*by, F.col("s.class").alias("class")).agg(F.sum("s.p").alias("n_pred"), F.sum("s.r").alias("n_ref"), F.sum("s.h").alias("hits"))
    user, producer = F.try_divide("hits", "n_pred"), F.try_divide("hits", "n_ref")
    out = out.withColumns({"user": user, "producer": producer})
    return out.withColumns({"commission": 1 - F.col("user"), "omission": 1 - F.col("producer"), "f1": F.try_divide(2 * F.col("hits"), F.col("n_pred") + F.col("n_ref"))})


def plain_without(rows: DataFrame, pred: str, ref: str, nodata, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, n_pred, n_ref, hits, commission, omission, accuracy): counts in which pairs with ``nodata`` on either side are zero, while its class stays on the axis.

    Rates have four digits, null where a class has no pixels left; ``accuracy`` is the group's. Classes are those met on
    either side before ``nodata`` is taken out.
    """
    by = list(by)
    axis = rows.select(*by, F.explode(F.array(pred, ref)).alias("class")).where(F.col("class").isNotNull()).distinct()
    held = plain(rows.where((F.col(pred) != F.lit(nodata)) & (F.col(ref) != F.lit(nodata))), pred, ref, by).select(*by, "class", "n_pred", "n_ref", "hits")
    both = axis.alias("a").join(held.alias("b"), same("a", "b", [*by, "class"]), "left").select("a.*", *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("n_pred", "n_ref", "hits")])
    group = Window.partitionBy(*by)  # one row a class
    rate = lambda n: F.bround(F.try_divide(F.col(n) - F.col("hits"), n), 4)
    return both.select(*by, "class", "n_pred", "n_ref", "hits", rate("n_pred").alias("commission"), rate("n_ref").alias("omission"), F.bround(F.try_divide(F.sum("hits").over(group), F.sum("n_ref").over(group)), 4).alias("accuracy"))


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of keys of two aliased tables, nulls too."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def sums_before(rows: DataFrame, order: str, values: Sequence[str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` (one for each value of ``order``, within each ``by``) with before_<value>: the sum of each value over all rows of the group that come earlier.

    Rows are dealt to partitions by ranges of ``by`` and ``order``; a window runs within a partition, and the group's
    totals in earlier partitions, one row each, are added to it. So no window holds all rows of a group, however many.
    """
    by = list(by)
    direction = F.desc(order) if descending else F.asc(order)
    ranged = cut(rows.repartitionByRange(*by, direction).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("_part", *by, *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    within = Window.partitionBy("_part", *by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    # a row a partition is few; groups may be many
    out = running.alias("a").join((totals if by else F.broadcast(totals)).alias("b"), same("a", "b", ["_part", *by]))
    return out.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], *[(F.col(f"b._{v}") + F.col(f"a.before_{v}")).alias(f"before_{v}") for v in values])


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the order of a column whose values are all different; by ranges, so no window holds all rows."""
    return sums_before(rows.withColumn("_one", F.lit(1)), order, ["_one"]).withColumn(name, F.col("before__one").cast("bigint")).drop("_one", "before__one")


def side_by_side(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Two tables put together row by row, the first of one beside the first of the other, nulls where one is longer; columns of equal names aren't allowed."""
    return numbered(left, left_order).join(numbered(right, right_order), "place", "full")


def auc(rows: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks, null where one class is missing.

    Scores are counted before they are ranked, so distinct scores alone pass the window.
    """
    each = rows.groupBy(*by, score).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    if by:
        before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        ranked = each.withColumn("before_neg", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    else:
        ranked = sums_before(each, score, ["neg"])
    out = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def roc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) for each distinct score taken as the least that counts as positive."""
    each = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    totals = F.broadcast(each.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row
    before = sums_before(each, "threshold", ["pos", "neg"], descending=True).crossJoin(totals)
    return before.select("threshold", F.try_divide(F.col("before_pos") + F.col("pos"), F.col("all_pos")).alias("tpr"), F.try_divide(F.col("before_neg") + F.col("neg"), F.col("all_neg")).alias("fpr"))


def brier(rows: DataFrame, truth: str, score: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(score) - F.col(truth).cast("int"), F.lit(2))).alias("brier"))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``): exact quantiles by linear interpolation.

    Values are counted first; running counts over distinct values, by ranges of them, then show which values the
    positions fall on. No group is held in a buffer or in one task.
    """
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = sums_before(counts, "v", ["n"], by=by)
    totals = ranged.groupBy(*by).agg(F.sum("n").alias("total"))
    if by:
        both = ranged.alias("a").join(totals.alias("b"), same("a", "b", by)).select("a.*", "b.total")
    else:
        both = ranged.crossJoin(F.broadcast(totals))  # one row
    placed = both.withColumns({"first": F.col("before_n"), "last": F.col("before_n") + F.col("n") - 1})
    out = []
    for name, share in shares.items():
        at = F.col("total") * share - share
        on = lambda k: F.max(F.when(k.between(F.col("first"), F.col("last")), F.col("v")))
        out.append((on(F.floor(at)) + (on(F.ceil(at)) - on(F.floor(at))) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*by).agg(*out)


QUARTILES = {"1q": 0.25, "2q": 0.5, "3q": 0.75}


def zone_fit(rows: DataFrame, zone: str, ref: str, pred: str) -> DataFrame:
    """For each zone r, errors by mean (U) and median (M) and whole quartiles of both series, without reference zeros and, with names that end in 0, with them.

    A side without pixels, or whose reference or prediction is zero everywhere, is judged on the series 0, 0, 1, 1 for both;
    where both series agree in half of the pixels and r is 1, r is stated as 0. A constant series has no r.
    """
    both = rows.where(F.col(ref).isNotNull() & F.col(pred).isNotNull()).select(F.col(zone).alias("zone"), F.col(ref).cast("double").alias("t"), F.col(pred).cast("double").alias("p"))
    sides = F.array(F.when(F.col("t") != 0, F.lit("")), F.lit("0"))
    long = both.withColumn("side", F.explode(F.array_compact(sides)))
    zones = both.select("zone").distinct().withColumn("side", F.explode(F.array(F.lit(""), F.lit("0"))))
    shown = long.groupBy("zone", "side").agg(F.max(F.col("t") != 0).alias("any_t"), F.max(F.col("p") != 0).alias("any_p"))
    empty = zones.join(shown.where("any_t AND any_p"), ["zone", "side"], "left_anti")
    stand_in = empty.withColumn("t", F.explode(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))).withColumn("p", F.col("t"))
    long = long.join(empty, ["zone", "side"], "left_anti").select("zone", "side", "t", "p").unionByName(stand_in.select("zone", "side", "t", "p"))
    long = cut(long.withColumn("d", F.abs(F.col("p") - F.col("t"))))
    stats = long.groupBy("zone", "side").agg(F.round(correlation("t", "p"), 2).alias("r"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 1).alias("rmseU"), F.round(F.avg("d"), 1).alias("maeU"))
    # the quartiles of all series at once
    each = long.select("zone", "side", F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in ("d", "t", "p")])))
    found = quantiles(each, ["zone", "side", "series"], "v", QUARTILES)
    of_series = lambda name, k: F.max(F.when(F.col("series") == name, F.col(k)))
    wide = found.groupBy("zone", "side").agg(of_series("d", "2q").alias("m"), *[of_series(name, k).alias(f"{name}{k}") for name in ("t", "p") for k in QUARTILES])
    stats = stats.alias("a").join(wide.alias("b"), same("a", "b", ["zone", "side"])).select("a.*", *[f"b.{c}" for c in wide.columns if c not in ("zone", "side")])
    stats = stats.withColumns({"maeM": F.round("m", 1), "rmseM": F.round("m", 1)}).drop("m")
    stats = stats.withColumn("r", F.when((F.col("maeM") == 0) & (F.col("r") == 1), 0.0).otherwise(F.col("r")))
    names = ["r", "rmseM", "rmseU", "maeM", "maeU", *[f"{n}{k}" for n in ("t", "p") for k in QUARTILES]]
    kept = lambda c: F.col(c).cast("int") if c[-1] == "q" else F.col(c)
    of = lambda c, side: F.max(F.when(F.col("side") == side, kept(c))).alias(c + side)
    return stats.groupBy(F.col("zone").alias(zone)).agg(*[of(c, side) for side in ("", "0") for c in names])


def rmse_by(rows: DataFrame, ref: str, pred: str, by: Sequence[str]) -> DataFrame:
    d = F.col(pred) - F.col(ref)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def area_weighted_rmse(samples: DataFrame, population: DataFrame, ref: str, pred: str, bin_of) -> DataFrame:
    """(bin, rmse, pct_area, weighted): error by reference bin, weighted by the predicted map's share in the bin."""
    d = F.col(pred) - F.col(ref)
    error = samples.groupBy(bin_of(F.col(ref)).alias("bin")).agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    area = population.groupBy(bin_of(F.col(pred)).alias("bin")).agg(F.count("*").alias("n"))
    area = area.withColumn("pct_area", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    return error.join(area, "bin").withColumn("weighted", F.col("rmse") * F.col("pct_area"))


def labels_of(columns: Sequence[tuple[DataFrame, Column]]) -> DataFrame:
    """All distinct class labels of several tables."""
    out = None
    for df, column in columns:
        own = df.select(column.alias("class"))
        out = own if out is None else out.union(own)
    return out.distinct()
