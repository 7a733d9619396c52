"""Audit of filters that interact: what each one removes, in every order they can be applied in.

1. Each row is tested once and becomes a mask, one bit for each filter that it fails; rows are counted by part and mask,
   all of them and those labelled good or toxic. That leaves 2 ** 5 counts a part.
2. A subset-zeta transform of the counts gives, for every set of filters, the rows that fail nothing outside it; read
   at the complement, what survives each set of filters.
3. A step of an order is the difference of two neighbouring sets: the filters before it, and those with its own. So
   all orders come from the same 32 sums, and so do the labels lost and the shares over all orders.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: The gap between words and the symbols that a filter looks for.
GAP, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails, null as empty. A: under 200 words; B: under half of the words distinct; C: over 3 capitals in 100 characters; D: one of the symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = [n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(failed)), F.lit(0))


def masks(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail exactly the filters of the mask, and those labelled.

    Null parts are the empty string, null texts empty ones. Filter E fails a row where a smaller ``key`` of the whole
    table has the same text (by SHA-256 of it); rows that repeat the smallest key pass, and so do null keys, which are
    smaller than none. A label counts if any row of ``labels`` for the key has it. Further columns are ignored; an
    empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failures(F.col(text)).alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))])
    # null keys have no label: a salt keeps them out of one task
    salted = rows.withColumn("salt", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")))
    rows = salted.join(known.withColumn("salt", F.lit(0).cast("bigint")), ["key", "salt"], "left").fillna(0, ["good", "toxic"])
    # copies meet as counts: for each text and kind of row its least key and the rows that have it
    kind = ["digest", "part", "mask", "good", "toxic"]
    keyed = rows.groupBy(*kind, "key").agg(F.count("*").alias("n"))
    kinds = keyed.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.min_by("n", "key").alias("n_least"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"))
    of_text = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("unkeyed") + F.when(F.col("least") == F.col("of_text"), F.col("n_least")).otherwise(0)
    split = kinds.withColumn("of_text", of_text).groupBy("part", "mask", "good", "toxic").agg(F.sum(passing).alias("first"), F.sum(F.col("n") - passing).alias("again"))
    copy = 1 << FILTERS.index("E")
    both = split.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), F.col("again").alias("n")))))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def zeta(counts: Column) -> Column:
    """The subset-zeta transform: each set's sum over all of its subsets, one filter's bit after another."""
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    return F.aggregate(bits, counts, lambda sums, bit: F.transform(sums, lambda own, s: own + F.when(s.bitwiseAND(bit) > 0, sums[s.bitwiseXOR(bit)]).otherwise(0)))


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of rows as ``masks`` gives them.

    A row for each part and each step of each order, zeros included; no parts, no rows.
    """
    measures = ("n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("of"))
    every = F.sequence(F.lit(0), F.lit(ALL))

    def by_mask(measure: str) -> Column:
        return F.transform(every, lambda s: F.coalesce(F.try_element_at("of", s)[measure], F.lit(0).cast("bigint")))

    parts = parts.select("part", *[by_mask(c).alias(c) for c in measures])
    sums = parts.select("part", F.col("n").alias("exactly"), *[zeta(F.col(c)).alias(c) for c in measures])

    def survivors(measure: str, removed: Column) -> Column:
        return F.col(measure)[removed.bitwiseXOR(F.lit(ALL))]

    def lost(measure: str, before: Column, bit: Column) -> Column:
        return survivors(measure, before) - survivors(measure, before.bitwiseOR(bit))

    orders = ",".join(map("".join, itertools.permutations(FILTERS)))
    weights = F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))])
    steps = sums.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    prefix = F.expr("left(filter_order, step - 1)")
    before = sum((F.when(F.contains(prefix, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"before": before, "bit": F.expr(f"shiftleft(1, locate(substr(filter_order, step, 1), '{FILTERS}') - 1)")})
    b, f = F.col("before"), F.col("bit")
    shapley = F.aggregate(F.filter(every, lambda s: s.bitwiseAND(f) == 0), F.lit(0).cast("bigint"), lambda total, s: total + weights[F.bit_count(s)] * lost("n", s, f))
    removed = lost("n", b, f)
    fails = survivors("n", F.lit(0)) - survivors("n", f)
    return steps.select(
        "part",
        "filter_order",
        "step",
        survivors("n", b.bitwiseOR(f)).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        F.col("exactly")[f].alias("unique_fails"),
        lost("good", b, f).alias("good_lost"),
        lost("toxic", b, f).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


_ORDERS_SQL = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations(FILTERS))

AUDIT_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN g USING (doc_id)),
k AS (SELECT part, good, toxic, map {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(left(filter_order, step - 1), '') AS before FROM (VALUES {_ORDERS_SQL}) v(filter_order), range(1, 6) r(step)),
x AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, n, good, toxic, fails[own] AS failing, len(list_filter(before, lambda y: y <> '' AND fails[y])) > 0 AS gone,
        len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) = 1 AS sole FROM k, o),
s AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT gone AND NOT failing) AS kept, sum(n) FILTER (WHERE NOT gone AND failing) AS removed, sum(n) FILTER (WHERE gone AND failing) AS redundant,
        sum(n) FILTER (WHERE sole AND failing) AS unique_fails, sum(n * good) FILTER (WHERE NOT gone AND failing) AS good_lost, sum(n * toxic) FILTER (WHERE NOT gone AND failing) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s
"""
