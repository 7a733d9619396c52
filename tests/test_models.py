"""Queries that train trees, recomputed by plain loops over the same members and node tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import trees
from parcelwise.plans import models
from parcelwise.sources import tables as src

DATA = "/root/testdata/sf0.001"


def by_set(nodes):
    out = defaultdict(dict)
    for r in nodes.collect():
        out[r.set_id][r.node] = r
    return out


def path(tree, row):
    """The nodes that a row passes, the leaf last."""
    seen = [tree[0]]
    while seen[-1].feature is not None:
        value = row[seen[-1].feature]
        seen.append(tree[seen[-1].left if value is not None and value <= seen[-1].threshold else seen[-1].right])
    return seen


def test_predictions_of_each_set_and_the_sets_without_a_model(spark):
    m = models.members(spark, DATA)
    rows = m.collect()
    nodes = by_set(trees.train_sets(m, "price", models.COLUMNS, least_rows=40))
    said, bag = defaultdict(list), defaultdict(int)
    for r in rows:
        bag[r.set_id] += r.in_bag
        if r.set_id in nodes:
            said[r.set_id].append(path(nodes[r.set_id], r)[-1].value)
    got = {r.set_id: r for r in models.predict_per_set(spark, DATA).collect()}
    assert set(got) == set(said) | {s for s in bag if bag[s] and s not in nodes}
    for s, r in got.items():
        if s in said:
            assert (r.n, r.problem) == (len(said[s]), None) and r["mean"] == pytest.approx(np.mean(said[s]), abs=1e-3)
        else:
            assert r.n == bag[s] and r.problem == "too few rows"


def test_the_feature_that_sees_most_of_each_class(spark):
    m = models.with_class(models.members(spark, DATA))
    columns = ["discount", "ref", "tax"]
    nodes = by_set(trees.train_sets(m, "label", columns, classes=True))
    seen = defaultdict(lambda: defaultdict(int))
    for r in m.where("in_bag").collect():
        if r.set_id in nodes and all(r[c] is not None for c in [*columns, "label"]):
            for node in path(nodes[r.set_id], r)[:-1]:
                seen[r.set_id, r.label][node.feature] += 1
    want = {k: min(v, key=lambda f: (-v[f], f)) for k, v in seen.items()}
    assert {(r.set_id, r.label): r.feature for r in models.class_importance(spark, DATA).collect()} == want and want


def test_fit_out_of_bag_by_the_size_of_rectangles(spark):
    times = (0.5, 1.0, 2.0)
    r = src.rectangles(spark, DATA).select("*", F.posexplode(F.array(*map(F.lit, times))).alias("k", "t"))
    grown = r.select((F.col("set_id") * 4 + F.col("k")).alias("set_id"), "ul_x", "ul_y", (F.col("ul_x") + F.col("t") * (F.col("lr_x") - F.col("ul_x"))).alias("lr_x"), (F.col("ul_y") - F.col("t") * (F.col("ul_y") - F.col("lr_y"))).alias("lr_y"))
    m = models.members(spark, DATA, grown)
    nodes = by_set(trees.train_sets(m, "ref", models.COLUMNS))
    pairs = defaultdict(list)
    for row in m.where("NOT in_bag").collect():
        if row.set_id in nodes:
            pairs[row.set_id].append((row.ref, path(nodes[row.set_id], row)[-1].value))
    found = defaultdict(list)
    for s, own in pairs.items():
        y, p = np.array(own, float).T
        total = ((y - y.mean()) ** 2).sum()
        found[times[s % 4]].append((round(100 * (1 - ((y - p) ** 2).sum() / total)) if total else None, round(np.sqrt(((y - p) ** 2).mean()))))
    got = {r.times: r for r in models.support_size_sweep(spark, DATA).collect()}
    assert set(got) == set(found) and len(found) == 3
    for t, own in found.items():
        rates = [a for a, _ in own if a is not None]
        assert got[t].n_sets == len(own) and got[t].oob_rate == pytest.approx(np.mean(rates), abs=1.01) and got[t].oob_rmse == pytest.approx(np.mean([b for _, b in own]), abs=1.01)
