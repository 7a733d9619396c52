"""Forests over whole tables, grown level by level from counts by node, feature and bin.

Rows are held once: their bins, their target and a key whose hash says which trees have them in bag, so no row is
repeated for a tree. A level is one pass. Each task leads its rows down the trees as far as they are grown, adds them up
by (tree, node, feature, bin, class) and hands on its sums; what meets in the shuffle has that many rows at most,
whatever the table, and what comes to the driver is one split for each node. Levels with very many cells take several
passes over some of the nodes each. Where the combinations of bins are few, all levels follow from sums by tree and
combination, and the rows are passed once. Node tables are those of ``trees``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import portable_hash
from ..session import cut
from .trees import LEAST_LEAF, NODES

#: Sums that a task holds in a pass.
MOST_CELLS = 4_000_000
#: Sums by tree, combination of bins and class up to which a forest is grown from one pass.
FEW_CELLS = 1 << 18
#: Which trees have a row in bag follows from its key and these.
STRIDE, BAG_SEED = 1_000_003, 17


def hashed(key: np.ndarray, seed: int) -> np.ndarray:
    """``portable_hash`` of whole numbers."""
    key = key.astype(np.int64).view(np.uint64)
    low, high, mask = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32), np.uint64(0xFFFFFFFF)
    once = (low * np.uint64(2654435761) + high * np.uint64(2246822519) + np.uint64(seed * 40503)) & mask
    return (once * np.uint64(1597334677) + np.uint64(12345)) & mask


def in_bag(key: np.ndarray, tree: int, fraction: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashed(key.astype(np.int64) + np.int64(tree * STRIDE), BAG_SEED) < int(fraction * 2**32)


def bag_of(key: Column, tree: Column, fraction: float = 0.63) -> Column:
    """Whether a tree has a row in bag."""
    return portable_hash(key + tree * STRIDE, BAG_SEED) < int(fraction * 2**32)


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """For each column the values that part its bins: at most ``bins`` - 1 approximate quantiles of all rows, of which every one is in the bag of some trees."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns]).first()  # one row
    return [sorted(set(found[c] or [])) for c in columns]


@dataclass
class Growth:
    """Trees on the way: the split of each node by heap number (1, its children 2 and 3, ...), -1 where it has none."""

    trees: int
    per_stage: int
    fraction: float
    feature: np.ndarray
    bin: np.ndarray

    def rows_of(self, tree: int, key: np.ndarray, bins: np.ndarray, keep: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the bag of a tree that reach its level, and the nodes that they are at."""
        rows = np.flatnonzero(keep & in_bag(key, tree % self.per_stage, self.fraction))
        node = np.ones(len(rows), np.int64)
        for _ in range(level):
            f = self.feature[tree, node]
            rows, node, f = rows[f >= 0], node[f >= 0], f[f >= 0]
            node = 2 * node + (bins[rows, f] > self.bin[tree, node])
        return rows, node


def _grow(rows: DataFrame, key: str, columns: list[str], stages: list[tuple[Column, Column]], n_classes: int, trees: int, max_depth: int, bins: int, max_features: int | None, fraction: float, seed: int) -> list[list[tuple]]:
    """The nodes of each tree, ``trees`` of them for each stage; a stage is a target and the rows that it is fitted to."""
    target = [c for k, (y, keep) in enumerate(stages) for c in (y.cast("double").alias(f"y{k}"), keep.cast("boolean").alias(f"keep{k}"))]
    edges = bin_edges(rows, columns, bins)
    number = lambda c, of: F.size(F.filter(F.array(*map(F.lit, of)), lambda e: e < F.col(c).cast("double"))).cast("smallint") if of else F.lit(0).cast("smallint")
    held = rows.dropna(subset=columns).select(F.col(key).cast("bigint").alias("key"), *[number(c, of).alias(f"b{k}") for k, (c, of) in enumerate(zip(columns, edges, strict=True))], *target)
    n_features, n_bins, n_stages, total = len(columns), bins, len(stages), trees * len(stages)
    grown = Growth(total, trees, fraction, np.full((total, 2 ** (max_depth + 1)), -1, np.int64), np.zeros((total, 2 ** (max_depth + 1)), np.int64))
    found: list[dict[int, tuple]] = [{} for _ in range(total)]
    wide = n_features * n_bins * n_classes
    sizes: dict[int, float] = {}
    widths = [len(of) + 1 for of in edges]
    few = math.prod(widths) * n_classes * total <= FEW_CELLS
    if few:
        found = _from_cells(held, widths, n_bins, n_stages, n_classes, trees, max_depth, max_features, fraction, seed)
    else:
        held = cut(held)
    for level in range(max_depth + 1) if not few else ():
        open_nodes = [(t, node) for t in range(total) for node in range(2**level, 2 ** (level + 1)) if level == 0 or grown.feature[t, node // 2] >= 0]
        step = max(1, MOST_CELLS // wide)
        for at in range(0, len(open_nodes), step):
            slots = open_nodes[at : at + step]
            slot_of = np.full((total, 2 ** (level + 1)), -1, np.int64)
            for k, (t, node) in enumerate(slots):
                slot_of[t, node] = k

            def counted(batches, level=level, slot_of=slot_of, n_slots=len(slots)):
                n, s = np.zeros(n_slots * wide), np.zeros(n_slots * wide)
                some = [t for t in range(total) if (slot_of[t] >= 0).any()]
                for b in batches:
                    own, at_bin, ys, keeps = _arrays(b, n_features, n_stages)
                    for t in some:
                        y = ys[t // trees]
                        picked, node = grown.rows_of(t, own, at_bin, keeps[t // trees], level)
                        slot = slot_of[t, node]
                        picked, slot = picked[slot >= 0], slot[slot >= 0]
                        label = y[picked].astype(np.int64) if n_classes > 1 else 0
                        for f in range(n_features):
                            cell = ((slot * n_features + f) * n_bins + at_bin[picked, f]) * n_classes + label
                            np.add.at(n, cell, 1) if len(cell) * 8 < len(n) else np.add(n, np.bincount(cell, minlength=len(n)), out=n)
                            if n_classes == 1:
                                np.add.at(s, cell, y[picked]) if len(cell) * 8 < len(s) else np.add(s, np.bincount(cell, y[picked], minlength=len(s)), out=s)
                there = np.flatnonzero(n)
                yield pa.record_batch({"cell": pa.array(there), "n": pa.array(n[there]), "s": pa.array((n if n_classes > 1 else s)[there])})

            drawn = {k: _drawn(t, node, n_features, max_features, seed) for k, (t, node) in enumerate(slots)} if max_features is not None and max_features < n_features else None
            least = {k: max(1, int(np.ceil(LEAST_LEAF * sizes[t]))) for k, (t, _) in enumerate(slots)} if level else {}

            def chosen(cells: pd.DataFrame) -> pd.DataFrame:
                out = []
                cells = cells.sort_values("cell")
                slot = (cells["cell"] // wide).to_numpy()
                for k in np.unique(slot):
                    own = cells[slot == k]
                    n, s = np.zeros(wide), np.zeros(wide)
                    place = (own["cell"] % wide).to_numpy()
                    n[place], s[place] = own["n"], own["s"]
                    out.append((int(k), *_best(n.reshape(n_features, n_bins, n_classes), s.reshape(n_features, n_bins, n_classes), least.get(int(k)), drawn[int(k)] if drawn else None, level == max_depth)))
                return pd.DataFrame(out, columns=["slot", "feature", "bin", "gain", "n", "value"])

            cells = held.mapInArrow(counted, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            deal = F.floor(F.col("cell") / wide) % 64
            best = cells.groupBy(deal.alias("deal")).applyInPandas(chosen, "slot int, feature int, bin int, gain double, n double, value double").collect()  # a row for each node
            for r in best:
                t, node = slots[r.slot]
                sizes.setdefault(t, r.n)
                found[t][node] = (r.feature, r.bin, r.gain, r.value)
                grown.feature[t, node], grown.bin[t, node] = r.feature, r.bin
        if (grown.feature[:, 2**level : 2 ** (level + 1)] < 0).all():
            break
    out = []
    for nodes in found:
        order = {node: k for k, node in enumerate(sorted(nodes))}
        split = lambda node, nodes=nodes: nodes[node][0] >= 0 and 2 * node in nodes and 2 * node + 1 in nodes
        out.append([(k, columns[nodes[h][0]], edges[nodes[h][0]][nodes[h][1]], order[2 * h], order[2 * h + 1], nodes[h][3], nodes[h][2]) if split(h) else (k, None, None, None, None, nodes[h][3], 0.0) for h, k in order.items()])
    return out


def _arrays(b: pa.RecordBatch, n_features: int, n_stages: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys, bins by column, and for each stage the target and the rows that it is fitted to."""
    at_bin = np.column_stack([b[f"b{k}"].to_numpy(zero_copy_only=False) for k in range(n_features)]).astype(np.int64)
    ys = [b[f"y{k}"].to_numpy(zero_copy_only=False) for k in range(n_stages)]
    keeps = [np.nan_to_num(b[f"keep{k}"].to_numpy(zero_copy_only=False).astype(float)).astype(bool) & ~np.isnan(ys[k]) for k in range(n_stages)]
    return b["key"].to_numpy(zero_copy_only=False), at_bin, ys, keeps


def _from_cells(rows: DataFrame, widths: list[int], n_bins: int, n_stages: int, n_classes: int, trees: int, max_depth: int, max_features: int | None, fraction: float, seed: int) -> list[dict[int, tuple]]:
    """(feature, bin, gain, value) of each node of each tree by heap number: one pass adds rows up by tree, combination of bins and class; each tree grows from its sums in one task."""
    n_features, total = len(widths), trees * n_stages
    n_cells = math.prod(widths) * n_classes

    def counted(batches):
        n, s = np.zeros((total, n_cells)), np.zeros((total, n_cells))
        for b in batches:
            own, at_bin, ys, keeps = _arrays(b, n_features, n_stages)
            cell = np.ravel_multi_index(at_bin.T, widths) * n_classes
            for t in range(trees):
                bag = in_bag(own, t, fraction)  # the same in each stage
                for k in range(n_stages):
                    picked = np.flatnonzero(bag & keeps[k])
                    at = cell[picked] + (ys[k][picked].astype(np.int64) if n_classes > 1 else 0)
                    n[k * trees + t] += np.bincount(at, minlength=n_cells)
                    if n_classes == 1:
                        s[k * trees + t] += np.bincount(at, ys[k][picked], minlength=n_cells)
        tree, there = np.nonzero(n)
        yield pa.record_batch({"tree": pa.array(tree.astype(np.int32)), "cell": pa.array(there), "n": pa.array(n[tree, there]), "s": pa.array((n if n_classes > 1 else s)[tree, there])})

    def grown(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell")
        tree, out = int(cells["tree"].iloc[0]), []
        combo, label = np.divmod(cells["cell"].to_numpy(), n_classes)
        at = np.stack(np.unravel_index(combo, widths))
        sums = [cells[c].to_numpy() for c in ("n", "s")]
        least = max(1, int(np.ceil(LEAST_LEAF * sums[0].sum())))

        def grow(some: np.ndarray, node: int, level: int) -> None:
            own = [np.zeros((n_features, n_bins, n_classes)) for _ in sums]
            for held, value in zip(own, sums, strict=True):
                for f in range(n_features):
                    np.add.at(held[f], (at[f, some], label[some]), value[some])
            drawn = _drawn(tree, node, n_features, max_features, seed) if max_features is not None and max_features < n_features else None
            f, edge, gain, _, value = _best(*own, least, drawn, level == max_depth)
            out.append((tree, node, f, edge, gain, value))
            if f >= 0:
                low = at[f, some] <= edge
                grow(some[low], 2 * node, level + 1)
                grow(some[~low], 2 * node + 1, level + 1)

        grow(np.arange(len(cells)), 1, 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gain", "value"])

    cells = rows.mapInArrow(counted, "tree int, cell long, n double, s double").groupBy("tree", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: list[dict[int, tuple]] = [{} for _ in range(total)]
    for r in cells.groupBy("tree").applyInPandas(grown, "tree int, node int, feature int, bin int, gain double, value double").collect():  # a row for each node
        found[r.tree][r.node] = (r.feature, r.bin, r.gain, r.value)
    return found


def _drawn(tree: int, node: int, n_features: int, most: int, seed: int) -> list[int]:
    """The features that a node may be split by."""
    return np.argsort(hashed(np.arange(n_features) + (tree * 4096 + node) * 64, seed), kind="stable")[:most].tolist()


def _best(n: np.ndarray, s: np.ndarray, least: int | None, drawn: list[int] | None, last: bool) -> tuple[int, int, float, float, float]:
    """(feature, bin, gain, rows, value) of a node from its counts and sums by feature, bin and class: the split that lowers the squared error most, -1 if none does."""
    total = n[0].sum()
    classes = n.shape[2] > 1
    value = float(np.argmax(n[0].sum(axis=0))) if classes else float(s[0].sum() / total)
    least = least or max(1, int(np.ceil(LEAST_LEAF * total)))
    best = (-1, 0, 0.0)
    whole = (s[0].sum(axis=0) ** 2).sum() / total
    for f in range(len(n)) if not last else ():
        if drawn is not None and f not in drawn:
            continue
        left_n, left_s = n[f].sum(axis=1).cumsum()[:-1], s[f].cumsum(axis=0)[:-1]
        right_n, right_s = total - left_n, s[f].sum(axis=0) - left_s
        ok = (left_n >= least) & (right_n >= least)
        gain = np.where(ok, (left_s**2).sum(axis=1) / np.maximum(left_n, 1) + (right_s**2).sum(axis=1) / np.maximum(right_n, 1) - whole, -1)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > 1e-9 and gain[k] > best[2]:
            best = f, k, float(gain[k])
    return *best, float(total), value


def _table(rows: DataFrame, forest: list[list[tuple]], values: Sequence[float] | None = None) -> DataFrame:
    """The node tables of trees; values of classes are numbers of ``values``."""
    flat = [(t, *node[:5], float(values[int(node[5])]) if values is not None else node[5], node[6]) for t, nodes in enumerate(forest) for node in nodes]
    return rows.sparkSession.createDataFrame(flat, NODES)


def grow_forest(rows: DataFrame, target: str, columns: Sequence[str], trees: int, key: str = "id", max_depth: int = 4, bins: int = 32, max_features: int | None = None, classes: bool = False, fraction: float = 0.63, seed: int = 1) -> DataFrame:
    """The node tables of ``trees`` trees over ``rows``, each from its own bag of about ``fraction`` of them.

    Rows with a null column take no part. Splits lie between bins; ``max_features`` draws that many columns for each
    node by a hash. ``key``: whole numbers that tell rows apart. No rows, no trees.
    """
    ordered = sorted(columns)
    rows = rows.where(F.col(target).isNotNull())
    values, y = None, F.col(target)
    if classes:
        values = [r[0] for r in rows.select(F.col(target).cast("double").alias("v")).distinct().orderBy("v").collect()]  # one row a class
        y = F.array_position(F.array(*map(F.lit, values)), F.col(target).cast("double")) - 1 if values else F.lit(0)
    forest = _grow(rows, key, ordered, [(y, F.lit(True))], max(len(values), 2) if classes else 1, trees, max_depth, bins, max_features, fraction, seed)
    return _table(rows, forest, values)


def grow_zero_inflated(rows: DataFrame, target: str, columns: Sequence[str], trees: int, key: str = "id", max_depth: int = 4, bins: int = 32, max_features: int | None = None, fraction: float = 0.63, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Node tables of two forests grown in the same passes: the share of rows whose target isn't zero, and the target where it isn't."""
    ordered = sorted(columns)
    rows = rows.where(F.col(target).isNotNull())
    present = F.col(target) != 0
    forest = _grow(rows, key, ordered, [(present.cast("int"), F.lit(True)), (F.col(target), present)], 1, trees, max_depth, bins, max_features, fraction, seed)
    return _table(rows, forest[:trees]), _table(rows, forest[trees:])


def _led(nodes: list, x: np.ndarray, columns: list[str]) -> np.ndarray:
    """The value that one tree gives each row."""
    place = {c: k for k, c in enumerate(columns)}
    feature = np.array([-1 if r.feature is None else place[r.feature] for r in nodes])
    threshold, left, right = (np.array([r[c] or 0 for r in nodes], kind) for c, kind in (("threshold", float), ("left", int), ("right", int)))
    at = np.zeros(len(x), int)
    while len(where := np.flatnonzero(feature[at] >= 0)):
        own = at[where]
        at[where] = np.where(x[where, feature[own]] <= threshold[own], left[own], right[own])
    return np.array([r["value"] for r in nodes])[at]


def predict_forest(rows: DataFrame, nodes: DataFrame, columns: Sequence[str], key: str = "id", out_of_bag: float | None = None) -> DataFrame:
    """(key, predictions ARRAY<DOUBLE>): what each tree, in order, predicts for each row, without a shuffle; the row's other columns stay.

    ``out_of_bag``: the fraction of the bags; trees that had a row in theirs give null for it. A null predictor goes right.
    """
    columns = sorted(columns)
    by_tree: dict[int, list] = {}
    for r in nodes.orderBy("set_id", "node").collect():  # trees x nodes, whatever the rows
        by_tree.setdefault(r.set_id, []).append(r)
    kept = rows.columns

    def led(batches):
        for b in batches:
            x = np.column_stack([b[f"_x{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))])
            values = np.column_stack([_led(n, x, columns) for n in by_tree.values()]) if by_tree else np.zeros((len(x), 0))
            hidden = np.zeros(values.shape, bool)
            if out_of_bag is not None:
                own = b["_key"].to_numpy(zero_copy_only=False)
                hidden = np.column_stack([in_bag(own, t, out_of_bag) for t in by_tree]) if by_tree else hidden
            ends = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), mask=hidden.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists], [*kept, "predictions"])

    asked = rows.select("*", F.col(key).cast("bigint").alias("_key"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    return asked.mapInArrow(led, rows.withColumn("predictions", F.lit(None).cast("array<double>")).schema)


def error_by_trees(rows: DataFrame, target: str, trees: int) -> DataFrame:
    """(n_trees, rmse, n): the error of the mean over the first n_trees of ``predictions``, nulls apart, of the rows that have any; running sums over each batch, of which a row for each number of trees is handed on."""

    def added(batches):
        for b in batches:
            said = b["predictions"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, trees)
            held = (~np.isnan(said)).cumsum(axis=1)
            apart = np.nan_to_num(said).cumsum(axis=1) / np.maximum(held, 1) - b[target].to_numpy(zero_copy_only=False).astype(float)[:, None]
            yield pa.record_batch({"n_trees": pa.array(np.arange(1, trees + 1, dtype=np.int32)), "ss": pa.array((apart**2 * (held > 0)).sum(axis=0)), "n": pa.array((held > 0).sum(axis=0))})

    sums = rows.select(target, "predictions").mapInArrow(added, "n_trees int, ss double, n long").groupBy("n_trees").agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("n_trees", F.sqrt(F.col("ss") / F.col("n")).alias("rmse"), "n")


def predict_zero_inflated(rows: DataFrame, models: tuple[DataFrame, DataFrame], columns: Sequence[str], key: str = "id", mean: bool = False) -> DataFrame:
    """(key, predictions): for each pair of trees the value where the share is over one half, else 0; with ``mean`` (key, prediction), their mean, null without trees.

    Trees part rows by their thresholds alone, so in each batch the rows between the same thresholds are led once.
    """
    columns = sorted(columns)
    forest: list[dict[int, list]] = []
    for nodes in models:
        forest.append({})
        for r in nodes.orderBy("set_id", "node").collect():  # trees x nodes, whatever the rows
            forest[-1].setdefault(r.set_id, []).append(r)
    present, value = forest
    edges = [np.unique([r.threshold for trees in forest for own in trees.values() for r in own if r.feature == c]) for c in columns]
    kind = rows.schema[key].dataType.simpleString()

    def led(batches):
        for b in batches:
            x = np.column_stack([b[f"_x{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))])
            # a null lies above all thresholds
            between = np.ravel_multi_index([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], [len(e) + 1 for e in edges])
            _, first, of = np.unique(between, return_index=True, return_inverse=True)
            some = x[first]
            said = [np.where(_led(own, some, columns) > 0.5, _led(value[t], some, columns) if t in value else 0.0, 0.0) for t, own in present.items()]
            values = np.column_stack(said) if said else np.zeros((len(some), 0))
            if mean:
                # from left to right, as a fold adds
                out = pa.array(values.cumsum(axis=1)[:, -1] / len(said)).take(pa.array(of)) if said else pa.nulls(len(x), pa.float64())
            else:
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(said)), pa.array(values[of].ravel()))
            yield pa.RecordBatch.from_arrays([b["_key"], out], [key, "prediction" if mean else "predictions"])

    asked = rows.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    return asked.mapInArrow(led, f"`{key}` {kind}, " + ("prediction double" if mean else "predictions array<double>"))
