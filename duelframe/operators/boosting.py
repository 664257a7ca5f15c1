"""Histogram boosting: leaf-first trees on binned features, softmax or logistic loss.

Features are cut into quantile bins once, and the binned matrix is stored. A fit is one barrier
stage over it: every task holds its rows' codes and scores, adds up gradients by node, feature
and bin, and the tasks exchange these partial sums, whose size follows bins, features and
leaves, never rows. From the same sums every task finds the same splits, so nothing goes back
and forth with the driver between nodes, trees or rounds.

A leaf is split if it has the best gain of all open leaves, until the leaf limit is reached.
With several tasks, all leaves that may still be split before the limit are measured in one
exchange, ahead of their turn; the trees are the same, with fewer exchanges.

Rows with a null or NaN feature go left at every split on it.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from duelframe.functions.columns import quoted

#: Parameters that a caller may leave out. A fit reads all rows, unless the caller bounds them by
#: `most_rows`; `task_rows` are the rows of one task as long as there are tasks to be had. An
#: exchange between tasks takes about a second however small it is, so fewer tasks fit faster
#: until a task's rows no longer fit its memory (a byte a feature, and some 40 for each class).
DEFAULTS = {
    "trees": 100, "rate": 0.1, "leaves": 31, "depth": 30, "min_rows": 20, "min_weight": 1e-3,
    "columns": 1.0, "rows": 1.0, "l1": 0.0, "l2": 0.0, "bins": 64, "seed": 0,
    "most_rows": None, "task_rows": 1_000_000,
}

#: Rows of a leaf that are added up at once, and bytes of an exchange that all tasks together send.
FEW_ROWS, EXCHANGE_BYTES = 4_096, 1 << 26

TREE_SCHEMA = "round int, class int, node int, feature int, bin int, left int, right int, value double, gain double, rows long"


@dataclass(frozen=True)
class Boosted:
    """A fitted model. `edges` are each feature's bin borders, `base` the scores before the
    first tree; `trees` has a row for each node, as in TREE_SCHEMA (feature -1: a leaf)."""

    features: list[str]
    classes: list[str]
    edges: list[list[float]]
    base: list[float]
    trees: pd.DataFrame


# ---- binned matrix ----


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Borders between quantile bins, ascending, nulls and NaN left out. One job; the driver
    gets `bins` numbers a feature. A value on a border belongs to the bin below."""
    if not features:
        return []
    shares = [i / bins for i in range(1, bins)]
    cleaned = df.select(*[F.nanvl(quoted(f).cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, f in enumerate(features)])
    found = cleaned.approxQuantile(cleaned.columns, shares, 1 / (8 * bins))
    return [sorted(set(values)) for values in found]


def codes_of(columns: list[pa.Array], edges: list[list[float]]) -> np.ndarray:
    """Bin numbers, one row of bytes for each row: 0 for a missing value, else from 1."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for i, column in enumerate(columns):
        values = column.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
        known = ~np.isnan(values)
        out[known, i] = np.searchsorted(edges[i], values[known], "left") + 1
    return out


def binned(df: DataFrame, features: list[str], edges: list[list[float]], keep: dict[str, Column]) -> DataFrame:
    """The columns `keep` and `codes`, a byte for each feature. At most 254 bins."""
    if any(len(e) > 253 for e in edges):
        raise ValueError("a code is one byte: at most 254 bins")
    sent = df.select(*[c.alias(n) for n, c in keep.items()], *[quoted(f).cast("double").alias(f"__{i}") for i, f in enumerate(features)])
    width = len(keep)
    schema = StructType(sent.schema.fields[:width] + [StructField("codes", BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(batch.columns[width:], edges)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], packed], [*batch.schema.names[:width], "codes"])

    return sent.mapInArrow(run, schema)


# ---- trees, in a task ----


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g, h, p: dict):
    return _shrunk(g, p["l1"]) ** 2 / (h + p["l2"] + 1e-300)


def best_splits(sums: np.ndarray, p: dict) -> list[tuple[float, int, int]]:
    """(gain, feature, bin) of the best split of each node: rows of bins up to `bin` go left.
    `sums` holds gradient, hessian and rows by node, feature and bin; the first of equals wins."""
    upto = np.cumsum(sums, axis=2)
    whole = upto[:, :, -1:, :]
    g, h, n = (upto[..., i] for i in range(3))
    wg, wh, wn = (whole[..., i] for i in range(3))
    gain = _worth(g, h, p) + _worth(wg - g, wh - h, p) - _worth(wg, wh, p)
    few = (n < p["min_rows"]) | (wn - n < p["min_rows"]) | (h < p["min_weight"]) | (wh - h < p["min_weight"])
    flat = np.where(few, -np.inf, gain).reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    width = sums.shape[2]
    return [(float(flat[i, j]), int(j // width), int(j % width)) for i, j in enumerate(at)]


class _Leaf:
    """An open leaf: its own rows here, its sums over all tasks, its best split."""

    def __init__(self, rows, sums, split, depth):
        self.rows, self.sums, self.split, self.depth = rows, sums, split, depth
        self.children = None
        self.node = None

    def total(self):
        return self.sums[0].sum(axis=0)


class _Tree:
    """One tree while it grows."""

    def __init__(self, root: _Leaf, p: dict):
        self.p, self.nodes, self.leaves = p, [], []
        self._place(root)

    def _place(self, leaf: _Leaf) -> None:
        leaf.node = len(self.nodes)
        self.nodes.append([-1, 0, -1, -1, 0.0])
        self.leaves.append(leaf)

    def _open(self) -> list[_Leaf]:
        ready = [x for x in self.leaves if x.depth < self.p["depth"] and x.split[0] > 1e-12]
        return sorted(ready, key=lambda x: (-x.split[0], x.node))

    def wanted(self, ahead: bool) -> list[_Leaf]:
        """Split measured leaves in their turn, then say which must be measured next."""
        while len(self.leaves) < self.p["leaves"]:
            ready = self._open()
            if not ready:
                return []
            first = ready[0]
            if first.children is None:
                room = self.p["leaves"] - len(self.leaves)
                return [x for x in ready[:room] if x.children is None] if ahead else [first]
            self.leaves.remove(first)
            gain, feature, bin_ = first.split
            left = len(self.nodes)
            self.nodes[first.node] = [feature, bin_, left, left + 1, gain]
            for child in first.children:
                self._place(child)
        return []


class _Fit:
    """What one task does of a fit: `exchange` adds an array over all tasks."""

    def __init__(self, codes, keys, exchange, several: bool, bins: int, p: dict):
        # Column by column, as sums and splits read them.
        self.codes, self.keys, self.exchange, self.several = np.asfortranarray(codes), keys, exchange, several
        self.width, self.p = bins + 1, p

    def _sums(self, used, rows, g, h, w) -> np.ndarray:
        """Sums by feature of `used` and bin. Both ways add the rows in the same order: many rows
        a feature at a time, few at once, as each call costs some microseconds."""
        weights = [x[rows] for x in (g, h, w)]
        if len(rows) > FEW_ROWS:
            out = np.empty((len(used), self.width, 3))
            for i, feature in enumerate(used):
                bins = self.codes[:, feature][rows].astype(np.intp)
                for j, x in enumerate(weights):
                    out[i, :, j] = np.bincount(bins, x, self.width)
            return out
        places, size = np.arange(len(used))[:, None] * self.width, len(used) * self.width
        flat = (self.codes.T[used[:, None], rows] + places).ravel()
        parts = [np.bincount(flat, np.tile(x, len(used)), size) for x in weights]
        return np.stack(parts, axis=-1).reshape(len(used), self.width, 3)

    def _in_round(self, step: int) -> np.ndarray:
        """1.0 for the rows that this round sees, by the hash of the row and the round."""
        if self.p["rows"] >= 1.0:
            return np.ones(len(self.keys))
        x = self.keys ^ np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(11)).astype(np.float64) / 2.0**53 < self.p["rows"]).astype(np.float64)

    def grow(self, step: int, gradients: list[tuple[np.ndarray, np.ndarray]]):
        """One tree for each class, grown side by side: [(features, tree)]."""
        p, seen = self.p, self._in_round(step)
        n_all = self.codes.shape[1]
        n_used = max(1, round(n_all * p["columns"]))
        work = []
        for c, (g, h) in enumerate(gradients):
            rng = np.random.default_rng([p["seed"], step, c])
            g *= seen
            h *= seen
            work.append((np.sort(rng.choice(n_all, n_used, replace=False)), g, h))
        everyone = np.arange(len(self.codes), dtype=np.min_scalar_type(-len(self.codes) - 1))
        sums = self.exchange(np.stack([self._sums(used, everyone, g, h, seen) for used, g, h in work]))
        trees = [_Tree(_Leaf(everyone, s, split, 0), p) for s, split in zip(sums, best_splits(sums, p), strict=True)]
        while True:
            wanted = [(c, leaf) for c, tree in enumerate(trees) for leaf in tree.wanted(self.several)]
            if not wanted:
                return [(used, tree) for (used, *_), tree in zip(work, trees, strict=True)]
            here, sides = [], []
            for c, leaf in wanted:
                used, g, h = work[c]
                _, feature, bin_ = leaf.split
                goes_left = self.codes[leaf.rows, used[feature]] <= bin_
                sides.append((leaf.rows[goes_left], leaf.rows[~goes_left]))
                # Only the side with fewer rows is added up; the other is what remains.
                n_left = leaf.sums[feature, : bin_ + 1, 2].sum()
                small = 0 if 2 * n_left <= leaf.sums[feature, :, 2].sum() else 1
                here.append((small, self._sums(used, sides[-1][small], g, h, seen)))
            small_sums = self.exchange(np.stack([s for _, s in here]))
            both = np.empty((2 * len(wanted), *small_sums.shape[1:]))
            for i, ((small, _), (_, leaf)) in enumerate(zip(here, wanted, strict=True)):
                both[2 * i + small] = small_sums[i]
                both[2 * i + 1 - small] = leaf.sums - small_sums[i]
            splits = best_splits(both, p)
            for i, (_, leaf) in enumerate(wanted):
                leaf.children = [_Leaf(sides[i][s], both[2 * i + s], splits[2 * i + s], leaf.depth + 1) for s in (0, 1)]

    def run(self, labels: np.ndarray, n_classes: int):
        """Base scores, then rows of TREE_SCHEMA."""
        p = self.p
        counts = self.exchange(np.bincount(labels, minlength=max(n_classes, 2)).astype(np.float64))
        shares = np.clip(counts / max(counts.sum(), 1.0), 1e-15, 1.0)
        base = np.log(shares) if n_classes > 1 else np.log(shares[1:] / shares[:1])
        scores = np.tile(base, (len(labels), 1))
        out = []
        for step in range(p["trees"]):
            probability = probabilities(scores)
            # Each class its own arrays, which are not kept beside the probabilities.
            gradients = []
            for c in range(n_classes):
                chance = probability[:, c]
                h = chance * (1.0 - chance) * (n_classes / (n_classes - 1) if n_classes > 1 else 1.0)
                gradients.append((chance - (labels == (c if n_classes > 1 else 1)), h))
            del probability, chance
            grown = self.grow(step, gradients)
            for c, (used, tree) in enumerate(grown):
                values, sizes = {}, {}
                for leaf in tree.leaves:
                    g_sum, h_sum, n = leaf.total()
                    values[leaf.node] = float(-p["rate"] * _shrunk(g_sum, p["l1"]) / (h_sum + p["l2"] + 1e-300))
                    sizes[leaf.node] = round(n)
                    scores[leaf.rows, c] += values[leaf.node]
                for i, (feature, bin_, left, right, gain) in enumerate(tree.nodes):
                    named = int(used[feature]) if feature >= 0 else -1
                    out.append((step, c, i, named, bin_, left, right, values.get(i, 0.0), gain, sizes.get(i, 0)))
        return base.tolist(), out


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Softmax over several classes, the logistic function for one column."""
    if scores.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-scores))
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


# ---- fit and score ----


def _task(columns: list[int], n_classes: int, bins: int, p: dict, several: bool):
    """The function of one task of a fit over (label, key, codes); the first task gives the
    trees, after one row whose `value`s are the base scores (round -1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get() if several else None
        first = context is None or context.partitionId() == 0
        labels, keys, codes = [], [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int16))
            keys.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            codes.append(rows[:, columns])
        labels = np.concatenate(labels) if labels else np.zeros(0, np.int16)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        codes = np.concatenate(codes) if codes else np.zeros((0, len(columns)), np.uint8)
        order = np.lexsort((labels, keys))  # the same sums in every run

        def exchange(mine: np.ndarray) -> np.ndarray:
            if context is None:
                return mine
            # In portions, as each goes through the driver to every task in one message.
            portions = max(1, -(-mine.nbytes * len(context.getTaskInfos()) // EXCHANGE_BYTES))
            out = []
            for portion in np.array_split(mine.ravel(), portions):
                texts = context.allGather(base64.b64encode(portion.tobytes()).decode())
                out.append(np.sum([np.frombuffer(base64.b64decode(t), np.float64) for t in texts], axis=0))
            return np.concatenate(out).reshape(mine.shape)

        codes, keys, labels = codes[order], keys[order], labels[order]
        del order
        fit = _Fit(codes, keys, exchange, several, bins, p)
        base, rows = fit.run(labels, n_classes)
        if first:
            rows = [(-1, c, 0, -1, 0, -1, -1, b, 0.0, 0) for c, b in enumerate(base)] + rows
            names = [part.split()[0] for part in TREE_SCHEMA.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            types = [kinds[part.split()[1]] for part in TREE_SCHEMA.split(", ")]
            arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _bounded(matrix: DataFrame, most: int | None, rows: int) -> DataFrame:
    """All rows, or where the caller bounds them and there are more, about `most` by key."""
    if most is None or rows <= most:
        return matrix
    return matrix.where(F.pmod(F.col("key"), F.lit(1_000_000)) < int(1_000_000 * most / rows))


def fit(
    matrix: DataFrame, label: str, classes: list[str], all_features: list[str], all_edges: list[list[float]],
    features: list[str], params: dict, slots: int | None = None,
) -> Boosted:
    """Fit on a stored binned matrix (`codes` over `all_features`, long `key`, int `label` from
    0, null for rows to leave out). One class: a two-class model of its probability.

    `slots` is how many tasks may run at once for this fit; a matrix up to `task_rows` needs one.
    """
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown boosting parameters: {sorted(unknown)}")
    p = DEFAULTS | params
    spark = matrix.sparkSession
    labelled = matrix.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("label"), "key", "codes")
    counted = labelled.count()
    if not counted:
        raise ValueError("no labelled rows to fit")
    rows = _bounded(labelled, p["most_rows"], counted)
    tasks = max(1, math.ceil(min(counted, p["most_rows"] or counted) / p["task_rows"]))
    # A barrier stage needs all its tasks at once, which executors that come and go cannot promise:
    # Spark refuses it there, and one task then reads all rows.
    elastic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    tasks = 1 if elastic else min(tasks, slots or spark.sparkContext.defaultParallelism)
    at = {f: i for i, f in enumerate(all_features)}
    columns = [at[f] for f in features]
    work = _task(columns, len(classes), p["bins"], p, tasks > 1)
    dealt = rows.repartition(tasks, "key") if tasks > 1 else rows.coalesce(1)
    found = dealt.mapInArrow(work, TREE_SCHEMA, barrier=tasks > 1).toPandas()
    base = found[found["round"] < 0].sort_values("class")["value"].tolist()
    trees = found[found["round"] >= 0].sort_values(["class", "round", "node"], ignore_index=True)
    return Boosted(list(features), list(classes), [all_edges[i] for i in columns], base, trees)


def _predictor(model: Boosted):
    """Scores of rows of codes, all trees of a class at a time."""
    plans = []
    for c in range(len(model.classes)):
        trees = model.trees[model.trees["class"] == c]
        rounds = trees["round"].to_numpy()
        roots = np.flatnonzero(trees["node"].to_numpy() == 0)
        offset = roots[np.searchsorted(rounds[roots], rounds)]
        feature, bin_, value = (trees[n].to_numpy() for n in ("feature", "bin", "value"))
        split = feature >= 0
        # A leaf is its own child, so that all trees can step until nobody moves.
        left = np.where(split, trees["left"].to_numpy() + offset, np.arange(len(trees)))
        right = np.where(split, trees["right"].to_numpy() + offset, np.arange(len(trees)))
        plans.append((roots, np.maximum(feature, 0), bin_, left, right, value))

    def scores(codes: np.ndarray) -> np.ndarray:
        out = np.tile(np.asarray(model.base), (len(codes), 1))
        rows = np.arange(len(codes))[:, None]
        for c, (roots, feature, bin_, left, right, value) in enumerate(plans):
            if not len(roots):
                continue
            node = np.tile(roots, (len(codes), 1))
            while True:
                after = np.where(codes[rows, feature[node]] <= bin_[node], left[node], right[node])
                if np.array_equal(after, node):
                    break
                node = after
            out[:, c] += value[node].sum(axis=1)
        return out

    return scores


def predict(df: DataFrame, model: Boosted, names: list[str], step: int = 512) -> DataFrame:
    """`df` with the probability of each class as the double columns `names`.

    The model travels with the tasks: its size follows trees and leaves, not rows."""
    width = len(df.columns)
    sent = df.select(*[quoted(c) for c in df.columns], *[quoted(f).cast("double").alias(f"__{i}") for i, f in enumerate(model.features)])
    schema = StructType(df.schema.fields + [StructField(n, DoubleType()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _predictor(model)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                found = probabilities(scores(codes_of(batch.columns[width:], model.edges)))
                made = [pa.array(found[:, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], [*batch.schema.names[:width], *names])

    return sent.mapInArrow(run, schema)
