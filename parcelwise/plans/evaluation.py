"""Queries on accuracy assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bin_number
from ..operators import accuracy
from ..sources import tables as src
from .common import rounded

sql = src.sql
EDGES = [(-1, 0)] + [(k, k + 10) for k in range(0, 100, 10)]


def binned(spark, d):
    p = src.pairs_in_order(spark, d)
    return p.withColumns({"p": bin_number(F.col("pred"), EDGES), "r": bin_number(F.col("ref"), EDGES)})


def matrix(spark, d):
    return accuracy.by_area(binned(spark, d), "p", "r", "sampled")


def area_adjusted(spark, d):
    classes = spark.range(len(EDGES)).select(F.col("id").cast("int").alias("class"))
    return rounded(accuracy.with_empty_classes(matrix(spark, d), classes))


def nodata_zeroed(spark, d):
    """Errors of each region's classes with class 0 as nodata."""
    return accuracy.plain_without(binned(spark, d), "p", "r", 0, ["priority"])


def int_bins(spark, d):
    """The matrix over as many bins as a number says, from the reference's range."""
    p = src.pairs_in_order(spark, d)
    edges = accuracy.equal_edges(p, "ref", 7)
    b = p.withColumns({"p": bin_number(F.col("pred"), edges), "r": bin_number(F.col("ref"), edges)})
    return rounded(accuracy.by_area(b, "p", "r", "sampled"))


def matched(best):
    """The matrix of samples that are matched with what lies around them, over the areas of the map itself."""

    def build(spark, d):
        rows = accuracy.with_matches(src.pairs_in_order(spark, d), "pred", "ref", "sampled", best)
        number = lambda c: bin_number(F.col(c), EDGES)
        samples = rows.where("sampled").select(number("sample_pred").alias("p"), number("sample_ref").alias("r"))
        return rounded(accuracy.by_area_of(rows.select(number("pred").alias("p")), samples, "p", "r"))

    return build


def class_accuracy(spark, d):
    m = accuracy.by_class(matrix(spark, d))
    return rounded(m.drop("user_ci", "producer_ci").withColumns({"user_pct": accuracy.in_percent(F.col("user")), "producer_pct": accuracy.in_percent(F.col("producer"))}))


def confidence(spark, d):
    m = accuracy.by_class(matrix(spark, d))
    return rounded(m.select("class", "user_ci", "producer_ci", accuracy.in_percent(F.col("user_ci")).alias("user_ci_pct"), accuracy.in_percent(F.col("producer_ci")).alias("producer_ci_pct")))


def kappa(spark, d):
    return rounded(accuracy.overall(matrix(spark, d)).select("accuracy", "accuracy_ci", "expected", "kappa"))


def disagreement(spark, d):
    return rounded(accuracy.overall(matrix(spark, d)).select("quantity", "allocation"))


def plain(spark, d):
    return accuracy.counts(binned(spark, d), "p", "r")


def report(spark, d):
    """Classes that are missing count as class 0."""
    return rounded(accuracy.plain(binned(spark, d).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("p", "r")}), "p", "r"))


def by_region(spark, d):
    """The area-adjusted matrix of each region beside the error of its samples."""
    b = binned(spark, d)
    m = accuracy.by_area(b, "p", "r", "sampled", ["priority"])
    return rounded(m.join(accuracy.rmse_by(b.where("sampled"), "ref", "pred", ["priority"]), "priority"))


def region_accuracy(spark, d):
    b = binned(spark, d)
    m = accuracy.by_area(b, "p", "r", "sampled", ["priority"])
    return rounded(accuracy.overall(m, ["priority"]).select("priority", "accuracy", "accuracy_ci", "expected", "kappa"))


def report_by_region(spark, d):
    return rounded(accuracy.plain(binned(spark, d), "p", "r", ["priority"]).select("priority", "class", "commission", "omission"))


def rmse_family(spark, d):
    return rounded(accuracy.errors(src.pairs_in_order(spark, d).where("sampled"), "ref", "pred"))


def errors_by_class(spark, d):
    return rounded(accuracy.errors(src.pairs_in_order(spark, d), "ref", "pred", ["priority"]))


def weighted_rmse(spark, d):
    p = src.pairs_in_order(spark, d)
    return rounded(accuracy.area_weighted_rmse(p.where("sampled"), p, "ref", "pred", lambda c: bin_number(c, EDGES)))


def agreement(spark, d):
    return rounded(accuracy.agreement(src.pairs_in_order(spark, d), "ref", "pred"), 5)


def covers(spark, d):
    """Pairs with a land-cover class from 0 to 4."""
    return src.pairs_in_order(spark, d).withColumn("cover", (F.col("id") % 5).cast("int"))


def agreement_by_class(spark, d):
    """Agreement and relative error of each cover class but 0."""
    c = covers(spark, d).where("cover <> 0")
    return rounded(accuracy.agreement(c, "ref", "pred", ["cover"]).join(accuracy.errors(c, "ref", "pred", ["cover"]).select("cover", "rmspe"), "cover"), 4)


def agreement_by_bin(spark, d):
    return rounded(accuracy.agreement(binned(spark, d).where("p = r"), "ref", "pred", ["p"]), 3)


def evaluation(spark, d):
    """What an evaluation states of a map in one row: agreement, errors, accuracy and kappa."""
    b = binned(spark, d)
    whole = accuracy.agreement(b, "ref", "pred")
    fit = accuracy.errors(b.where("sampled"), "ref", "pred").withColumnRenamed("n", "n_samples")
    return rounded(whole.crossJoin(fit).crossJoin(accuracy.overall(accuracy.by_area(b, "p", "r", "sampled"))), 4)  # one row each


def scored(spark, d):
    return src.votes(spark, d).select((F.col("flag") == "R").alias("truth"), (F.round(F.col("discount") * 10, 6) + (F.col("vote") % 7) / 10).alias("score"), "set_id")


def auc_rank(spark, d):
    return rounded(accuracy.auc(scored(spark, d), "truth", "score"))


def auc_by_class(spark, d):
    """Sets that show both classes."""
    s = scored(spark, d).withColumn("y", F.col("truth").cast("double"))
    both = accuracy.auc(s, "truth", "score", ["set_id"]).where("n_pos > 0 AND n_neg > 0")
    return rounded(both.join(accuracy.rmse_by(s, "y", "score", ["set_id"]), "set_id"))


def roc(spark, d):
    return rounded(accuracy.roc(scored(spark, d), "truth", "score"))


def brier(spark, d):
    return rounded(accuracy.brier(scored(spark, d), "truth", "score"))


def zone_fit(spark, d):
    return rounded(accuracy.zone_fit(src.pairs_in_order(spark, d), "priority", "ref", "pred"))


def oob_fit(spark, d):
    """Reference against prediction for each set over its rows out of bag."""
    from .samples import oob_rows

    rows = oob_rows(spark, d).join(src.pairs_in_order(spark, d).select("id", "ref", "pred"), "id")
    r = rows.groupBy("set_id").agg(accuracy.correlation("ref", "pred").alias("r"))
    return rounded(accuracy.errors(rows, "ref", "pred", ["set_id"]).select("set_id", "rmse", "mae", "n").join(r, "set_id"))


BIN = "CAST(CASE WHEN {c} = 0 THEN 0 ELSE ceil({c} / 10.0) END AS INTEGER)"
BINNED = f"b AS (SELECT *, {BIN.format(c='pred')} AS p, {BIN.format(c='ref')} AS r FROM pair)"
REGIONS = """cnt AS (SELECT {by} p, r, count(*) AS every, count(*) FILTER (WHERE sampled) AS n FROM b GROUP BY ALL), area AS (SELECT {by} p AS pred, CAST(sum(every) AS BIGINT) AS total_pxl, sum(n) AS held FROM cnt GROUP BY ALL),
  share AS (SELECT {by} pred, total_pxl, held, total_pxl / CAST(sum(total_pxl) OVER ({part}) AS DOUBLE) AS pct_area FROM area),
  cells AS (SELECT {a} s.pred, q.pred AS ref, s.total_pxl, s.pct_area, coalesce(g.n, 0) AS n FROM share s JOIN share q ON s.held > 0 AND q.held > 0 {same} LEFT JOIN cnt g ON g.p = s.pred AND g.r = q.pred {here}),
  m AS (SELECT {by} pred, ref, n, total_pxl, pct_area, CAST(sum(n) OVER ({parts} pred) AS BIGINT) AS n_pred, n / CAST(nullif(sum(n) OVER ({parts} pred), 0) AS DOUBLE) * pct_area AS adj FROM cells)"""
MATRIX = f"{BINNED}, " + REGIONS.format(by="", part="", a="", same="", here="", parts="PARTITION BY")
BY_REGION = f"{BINNED}, " + REGIONS.format(by="priority,", part="PARTITION BY priority", a="s.priority,", same="AND s.priority = q.priority", here="AND g.priority = s.priority", parts="PARTITION BY priority,")
#: The same for bins that may leave values out, and for samples apart from the map.
KNOWN = "AND s.pred IS NOT NULL AND q.pred IS NOT NULL"
INT_BIN = "CAST(CASE WHEN {c} = 0 THEN 0 WHEN {c} > 0 AND ceil({c} / CAST(s AS DOUBLE)) <= ceil(w / CAST(s AS DOUBLE)) THEN ceil({c} / CAST(s AS DOUBLE)) END AS INTEGER)"
INT_MATRIX = f"e AS (SELECT max(ref) - min(ref) AS w, (max(ref) - min(ref)) // 7 AS s FROM pair), b AS (SELECT pair.*, {INT_BIN.format(c='pred')} AS p, {INT_BIN.format(c='ref')} AS r FROM pair, e), " + REGIONS.format(by="", part="", a="", same=KNOWN, here="", parts="PARTITION BY")
AROUND = """near AS (SELECT a.id, a.pred, b.pred AS near_pred, b.ref AS near_ref, (i + 1) * 3 + j + 1 AS k FROM pair a, range(-1, 2) x(i), range(-1, 2) y(j), pair b WHERE a.sampled AND b."row" = a."row" + i AND b.col = a.col + j),
  smp AS (SELECT id, any_value(pred) AS pred, arg_min(near_ref, (abs(near_ref - pred), k)) AS best, CAST(trunc(avg(near_pred)) AS INTEGER) AS mean_pred, CAST(trunc(avg(near_ref)) AS INTEGER) AS mean_ref FROM near GROUP BY id)"""


def matched_sql(pred: str, ref: str) -> str:
    cells = REGIONS.format(by="", part="", a="", same=KNOWN, here="", parts="PARTITION BY").replace("count(*) AS every, count(*) FILTER (WHERE sampled) AS n", "count(*) FILTER (WHERE of_map) AS every, count(*) FILTER (WHERE NOT of_map) AS n")
    both = f"b AS (SELECT {BIN.format(c='pred')} AS p, NULL AS r, true AS of_map FROM pair UNION ALL SELECT {BIN.format(c=pred)}, {BIN.format(c=ref)}, false FROM smp)"
    return sql("pair", body=f", {AROUND}, {both}, {cells} {LONG}")


LONG = "SELECT pred, ref, n, total_pxl, round(pct_area, 6) AS pct_area, n_pred, round(adj, 6) AS adj FROM m"
CLASSES = """u AS (SELECT pred AS class, any_value(n_pred) AS n, any_value(total_pxl) AS total_pxl, any_value(pct_area) AS pct_area, sum(n) FILTER (WHERE pred = ref) / CAST(nullif(any_value(n_pred), 0) AS DOUBLE) AS usr FROM m GROUP BY pred),
  c AS (SELECT ref AS class, sum(adj) AS col, coalesce(sum(adj) FILTER (WHERE pred = ref), 0) AS diag, sum(total_pxl * n / CAST(n_pred AS DOUBLE)) AS est,
    coalesce(sum(CAST(total_pxl AS DOUBLE) * total_pxl * (n / CAST(n_pred AS DOUBLE)) * (1 - n / CAST(n_pred AS DOUBLE)) / (n_pred - 1)) FILTER (WHERE pred <> ref AND n_pred > 1), 0) AS others FROM m GROUP BY ref),
  k AS (SELECT u.*, c.diag / nullif(c.col, 0) AS prod, c.est, c.others FROM u LEFT JOIN c USING (class))"""
OVERALL = """rr AS (SELECT pred AS class, any_value(n_pred) AS nr, any_value(pct_area) AS w, sum(n) FILTER (WHERE pred = ref) AS hit, coalesce(sum(adj) FILTER (WHERE pred = ref), 0) AS diag FROM m GROUP BY pred),
  cc AS (SELECT ref AS class, sum(n) AS nc FROM m GROUP BY ref), o AS (SELECT *, hit / CAST(nullif(nr, 0) AS DOUBLE) AS u FROM rr JOIN cc USING (class)),
  x AS (SELECT sum(diag) AS accuracy, 1.96 * sqrt(sum(w * w * u * (1 - u) / (nr - 1)) FILTER (WHERE nr > 1)) AS accuracy_ci, sum(CAST(nr AS DOUBLE) * nc) / pow(sum(nr), 2) AS expected, sum(abs(nr - nc)) / 2 AS quantity, CAST(sum(least(nr - hit, nc - hit)) AS DOUBLE) AS allocation FROM o)"""
ERR = """round(sqrt(avg((pred - ref) * CAST(pred - ref AS DOUBLE))), 6) AS rmse, round(100 * sqrt(avg(pow((pred - ref) / CAST(nullif(ref, 0) AS DOUBLE), 2))), 6) AS rmspe, round(avg(abs(pred - ref)), 6) AS mae, round(median(abs(pred - ref)), 6) AS mae_median, round(avg(pred - ref), 6) AS bias, count(*) AS n"""
PLAIN = """e AS (SELECT {by} p AS class, 1 AS np, 0 AS nr, CAST(p = r AS INTEGER) AS h FROM b UNION ALL SELECT {by} r, 0, 1, 0 FROM b),
  g AS (SELECT {by} class, CAST(sum(np) AS BIGINT) AS n_pred, CAST(sum(nr) AS BIGINT) AS n_ref, CAST(sum(h) AS BIGINT) AS hits FROM e GROUP BY ALL),
  f AS (SELECT *, hits / CAST(nullif(n_pred, 0) AS DOUBLE) AS usr, hits / CAST(nullif(n_ref, 0) AS DOUBLE) AS prd FROM g)"""
SCORED = "s AS (SELECT flag = 'R' AS truth, round(discount * 10, 6) + (vote % 7) / 10.0::DOUBLE AS score, set_id FROM votes)"


def agreement_sql(by: str, rows: str, digits: int, name: str = "") -> str:
    first = f"{by} AS {name or by}, " if by else ""
    by = name or by
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return sql("pair", body=f""", {BINNED}, h AS (SELECT {first}CAST(ref AS DOUBLE) AS x, CAST(pred AS DOUBLE) AS y FROM b {rows}),
      f AS (SELECT *, avg(x) OVER ({part}) AS mx, avg(y) OVER ({part}) AS my, corr(x, y) OVER ({part}) AS r, var_pop(x) OVER ({part}) AS vx, var_pop(y) OVER ({part}) AS vy FROM h),
      g AS (SELECT *, CASE WHEN vx > 0 AND vy > 0 AND r <> 0 THEN sign(r) * sqrt(vy / vx) END AS b FROM f),
      s AS (SELECT {keys}sum((x - y) * (x - y)) AS ssd, sum((abs(mx - my) + abs(x - mx)) * (abs(mx - my) + abs(y - my))) AS spod, sum(abs(x - (y - (my - b * mx)) / b) * abs(y - (my - b * mx) - b * x)) AS spdu, count(*) AS n FROM g {"GROUP BY " + by if by else ""})
      SELECT {keys}round(CASE WHEN spod <> 0 AND spdu IS NOT NULL THEN 1 - ssd / spod END, {digits}) AS ac, round(CASE WHEN spod <> 0 THEN 1 - (ssd - spdu) / spod END, {digits}) AS ac_sys, round(CASE WHEN spod <> 0 THEN 1 - spdu / spod END, {digits}) AS ac_unsys, n FROM s""")


def auc_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    out = f"""SELECT {keys}round(sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r"""
    if by:
        out = f"SELECT a.*, e.rmse FROM ({out} GROUP BY {by} HAVING sum(pos) > 0 AND sum(neg) > 0) a JOIN (SELECT {by}, round(sqrt(avg(pow(score - CAST(truth AS INTEGER), 2))), 6) AS rmse FROM s GROUP BY {by}) e USING ({by})"
    return sql("votes", body=f""", {SCORED}, e AS (SELECT {keys}score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM s GROUP BY ALL),
      r AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e) {out}""")


FIT_NAMES = ("r", "rmseM", "rmseU", "maeM", "maeU", "t1q", "t2q", "t3q", "p1q", "p2q", "p3q")
FIT = """, h AS (SELECT priority, x.side, CAST(ref AS DOUBLE) AS t, CAST(pred AS DOUBLE) AS p FROM pair JOIN (VALUES (''), ('0')) x(side) ON x.side = '0' OR ref <> 0),
  z AS (SELECT * FROM (SELECT DISTINCT priority FROM pair) CROSS JOIN (VALUES (''), ('0')) x(side)), g AS (SELECT priority, side FROM h GROUP BY ALL HAVING bool_or(t <> 0) AND bool_or(p <> 0)),
  u AS (SELECT h.* FROM h SEMI JOIN g USING (priority, side) UNION ALL SELECT priority, side, v, v FROM (SELECT * FROM z ANTI JOIN g USING (priority, side)) CROSS JOIN (VALUES (0.0::DOUBLE), (0.0), (1.0), (1.0)) y(v)),
  f AS (SELECT priority, side, round(corr(t, p), 2) AS r, round(median(abs(p - t)), 1) AS rmseM, round(sqrt(avg((p - t) * (p - t))), 1) AS rmseU, round(median(abs(p - t)), 1) AS maeM, round(avg(abs(p - t)), 1) AS maeU,
    """ + ", ".join(f"CAST(trunc(quantile_cont({c}, {q})) AS INTEGER) AS {c}{k}q" for c in "tp" for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + """ FROM u GROUP BY ALL),
  w AS (SELECT * REPLACE (CASE WHEN maeM = 0 AND r = 1 THEN 0.0 ELSE r END AS r) FROM f)
  SELECT priority, """ + ", ".join(f"max({c}) FILTER (WHERE side = '{side}') AS {c}{side}" for side in ("", "0") for c in FIT_NAMES) + " FROM w GROUP BY priority"

ALL = {
    "confusion_area_adjusted": (area_adjusted, sql("pair", body=f""", {MATRIX} SELECT CAST(x.k AS INTEGER) AS pred, CAST(y.k AS INTEGER) AS ref, n, total_pxl, round(pct_area, 6) AS pct_area, n_pred, round(adj, 6) AS adj
      FROM range(11) x(k) CROSS JOIN range(11) y(k) LEFT JOIN m ON m.pred = x.k AND m.ref = y.k""")),
    "confusion_nodata_zeroed": (nodata_zeroed, sql("pair", body=f""", {BINNED}, a AS (SELECT DISTINCT priority, unnest([p, r]) AS class FROM b), h AS (SELECT * FROM b WHERE p <> 0 AND r <> 0),
      c AS (SELECT a.*, (SELECT count(*) FROM h WHERE h.priority = a.priority AND h.p = a.class) AS n_pred, (SELECT count(*) FROM h WHERE h.priority = a.priority AND h.r = a.class) AS n_ref, (SELECT count(*) FROM h WHERE h.priority = a.priority AND h.r = a.class AND h.p = a.class) AS hits FROM a WHERE class IS NOT NULL)
      SELECT *, round_even((n_pred - hits) / CAST(nullif(n_pred, 0) AS DOUBLE), 4) AS commission, round_even((n_ref - hits) / CAST(nullif(n_ref, 0) AS DOUBLE), 4) AS omission, round_even(sum(hits) OVER (PARTITION BY priority) / CAST(sum(n_ref) OVER (PARTITION BY priority) AS DOUBLE), 4) AS accuracy FROM c""")),
    "confusion_int_bins": (int_bins, sql("pair", body=f", {INT_MATRIX} {LONG}")),
    "confusion_best_match": (matched(True), matched_sql("pred", "best")),
    "confusion_mean_match": (matched(False), matched_sql("mean_pred", "mean_ref")),
    "confusion_class_accuracy": (class_accuracy, sql("pair", body=f', {MATRIX}, {CLASSES} SELECT class, n, total_pxl, round(pct_area, 6) AS pct_area, round(usr, 6) AS "user", round(prod, 6) AS producer, round(round(usr, 3) * 100, 1) AS user_pct, round(round(prod, 3) * 100, 1) AS producer_pct FROM k')),
    "confusion_ci": (confidence, sql("pair", body=f""", {MATRIX}, {CLASSES}, w AS (SELECT class, CASE WHEN n > 1 THEN 1.96 * sqrt(usr * (1 - usr) / (n - 1)) END AS u,
      CASE WHEN n > 1 THEN 1.96 * sqrt((CAST(total_pxl AS DOUBLE) * total_pxl * (1 - prod) * (1 - prod) * usr * (1 - usr) / (n - 1) + prod * prod * others) / (est * est)) END AS p FROM k)
      SELECT class, round(u, 6) AS user_ci, round(p, 6) AS producer_ci, round(round(u, 3) * 100, 1) AS user_ci_pct, round(round(p, 3) * 100, 1) AS producer_ci_pct FROM w""")),
    "confusion_kappa": (kappa, sql("pair", body=f", {MATRIX}, {OVERALL} SELECT round(accuracy, 6) AS accuracy, round(accuracy_ci, 6) AS accuracy_ci, round(expected, 6) AS expected, round((accuracy - expected) / (1 - expected), 6) AS kappa FROM x")),
    "quantity_allocation_disagreement": (disagreement, sql("pair", body=f", {MATRIX}, {OVERALL} SELECT round(CAST(quantity AS DOUBLE), 6) AS quantity, round(allocation, 6) AS allocation FROM x")),
    "confusion_plain": (plain, sql("pair", body=f", {BINNED} SELECT p AS pred, r AS ref, count(*) AS n FROM b GROUP BY ALL")),
    "classification_report": (report, sql("pair", body=f', {BINNED.replace("b AS", "b0 AS")}, b AS (SELECT * REPLACE (coalesce(p, 0) AS p, coalesce(r, 0) AS r) FROM b0), {PLAIN.format(by="")} SELECT class, n_pred, n_ref, hits, round(usr, 6) AS "user", round(prd, 6) AS producer, round(1 - usr, 6) AS commission, round(1 - prd, 6) AS omission, round(2 * hits / CAST(n_pred + n_ref AS DOUBLE), 6) AS f1 FROM f')),
    "confusion_by_region": (by_region, sql("pair", body=f""", {BY_REGION}, e AS (SELECT priority, round(sqrt(avg((pred - ref) * CAST(pred - ref AS DOUBLE))), 6) AS rmse FROM b WHERE sampled GROUP BY priority)
      SELECT priority, pred, ref, n, total_pxl, round(pct_area, 6) AS pct_area, n_pred, round(adj, 6) AS adj, rmse FROM m JOIN e USING (priority)""")),
    "region_accuracy": (region_accuracy, sql("pair", body=f""", {BY_REGION}, u AS (SELECT priority, pred AS class, any_value(n_pred) AS nr, any_value(pct_area) AS w, sum(n) FILTER (WHERE pred = ref) AS hit, sum(adj) FILTER (WHERE pred = ref) AS diag FROM m GROUP BY ALL),
      c AS (SELECT priority, ref AS class, sum(n) AS nc FROM m GROUP BY ALL), j AS (SELECT *, hit / CAST(nullif(nr, 0) AS DOUBLE) AS u FROM u JOIN c USING (priority, class)),
      x AS (SELECT priority, coalesce(sum(diag), 0) AS accuracy, 1.96 * sqrt(sum(w * w * u * (1 - u) / (nr - 1)) FILTER (WHERE nr > 1)) AS accuracy_ci, sum(CAST(nr AS DOUBLE) * nc) / pow(sum(nr), 2) AS expected FROM j GROUP BY priority)
      SELECT priority, round(accuracy, 6) AS accuracy, round(accuracy_ci, 6) AS accuracy_ci, round(expected, 6) AS expected, round((accuracy - expected) / (1 - expected), 6) AS kappa FROM x""")),
    "confusion_omission_commission": (report_by_region, sql("pair", body=f", {BINNED}, {PLAIN.format(by='priority,')} SELECT priority, class, round(1 - usr, 6) AS commission, round(1 - prd, 6) AS omission FROM f")),
    "rmse_family": (rmse_family, sql("pair", body=f"SELECT {ERR} FROM pair WHERE sampled")),
    "errors_by_class": (errors_by_class, sql("pair", body=f"SELECT priority, {ERR} FROM pair GROUP BY priority")),
    "area_weighted_rmse": (weighted_rmse, sql("pair", body=f""", {BINNED}, e AS (SELECT r AS bin, sqrt(avg((pred - ref) * CAST(pred - ref AS DOUBLE))) AS rmse FROM b WHERE sampled GROUP BY r), a AS (SELECT p AS bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct_area FROM b GROUP BY p)
      SELECT bin, round(rmse, 6) AS rmse, round(pct_area, 6) AS pct_area, round(rmse * pct_area, 6) AS weighted FROM e JOIN a USING (bin)""")),
    "agreement_coefficient": (agreement, agreement_sql("", "", 5)),
    "agreement_by_class": (agreement_by_class, agreement_sql("CAST(id % 5 AS INTEGER)", "WHERE id % 5 <> 0", 4, "cover").replace("SELECT cover, round", "SELECT cover, (SELECT round(100 * sqrt(avg(pow((pred - ref) / CAST(nullif(ref, 0) AS DOUBLE), 2))), 4) FROM pair z WHERE z.id % 5 = s.cover) AS rmspe, round")),
    "agreement_by_bin": (agreement_by_bin, agreement_sql("p", "WHERE p = r", 3)),
    "evaluation": (evaluation, agreement_sql("", "", 4).replace("SELECT round(CASE WHEN spod", f", ev AS (SELECT round(CASE WHEN spod", 1) + f"), fit AS (SELECT {ERR.replace(', 6)', ', 4)').replace('AS n', 'AS n_samples')} FROM b WHERE sampled), {MATRIX.replace(BINNED + ', ', '')}, {OVERALL} SELECT ev.*, fit.*, round(accuracy, 4) AS accuracy, round(accuracy_ci, 4) AS accuracy_ci, round(expected, 4) AS expected, round(quantity, 4) AS quantity, round(allocation, 4) AS allocation, round((accuracy - expected) / (1 - expected), 4) AS kappa FROM ev, fit, x"),
    "auc_rank": (auc_rank, auc_sql("")),
    "auc_by_class": (auc_by_class, auc_sql("set_id")),
    "roc_curve": (roc, sql("votes", body=f""", {SCORED}, e AS (SELECT score AS threshold, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM s GROUP BY 1)
      SELECT round(threshold, 6) AS threshold, round(sum(pos) OVER (ORDER BY threshold DESC) / CAST(sum(pos) OVER () AS DOUBLE), 6) AS tpr, round(sum(neg) OVER (ORDER BY threshold DESC) / CAST(sum(neg) OVER () AS DOUBLE), 6) AS fpr FROM e""")),
    "brier": (brier, sql("votes", body=f", {SCORED} SELECT round(avg(pow(score - CAST(truth AS INTEGER), 2)), 6) AS brier FROM s")),
    "zone_fit_stats": (zone_fit, sql("pair", body=FIT)),
    "oob_fit": (oob_fit, sql("pair", body=""", v AS (SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY (((id * 2654435761 + 5 * 40503) % 4294967296) * 1597334677 + 12345) % 4294967296, id) > floor(0.63 * count(*) OVER (PARTITION BY set_id)) AS oob FROM (SELECT DISTINCT set_id, id FROM votes))
      SELECT v.set_id, round(sqrt(avg((pred - ref) * CAST(pred - ref AS DOUBLE))), 6) AS rmse, round(avg(abs(pred - ref)), 6) AS mae, round(corr(ref, pred), 6) AS r, count(*) AS n FROM v JOIN pair USING (id) WHERE oob GROUP BY v.set_id""")),
}
