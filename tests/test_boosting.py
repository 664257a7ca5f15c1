"""Histogram boosting against a plain version of it, over one task and several."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duelframe.operators import boosting as B
from duelframe.session import cut_lineage

FEATURES = ["a", "b", "c"]
CLASSES = ["A", "D", "H"]
PARAMS = {"trees": 4, "rate": 0.3, "leaves": 6, "depth": 3, "min_rows": 5, "l1": 0.2, "l2": 0.5, "bins": 16}


def made_rows(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(6)), rng.random()
        label = 0 if a + rng.gauss(0, 0.5) > 0.6 else (1 if b >= 3 and c < 0.7 else 2)
        rows.append((i, a if i % 17 else None, b, c if i % 23 else math.nan, label if i % 31 else None))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return cut_lineage(spark.createDataFrame(made_rows(400), "id long, a double, b double, c double, label int").repartition(3))


def matrix_of(table, bins=16):
    edges = B.bin_edges(table, FEATURES, bins)
    keep = {"id": F.col("id"), "label": F.col("label"), "two": F.when(F.col("label") == 0, 1).otherwise(0)}
    return cut_lineage(B.binned(table, FEATURES, edges, keep).withColumn("key", F.xxhash64("id"))), edges


@pytest.fixture(scope="module")
def matrix(table):
    return matrix_of(table)


def plain_tree(rows, g, h, p, width):
    """Leaf-first tree by scanning every split of every leaf: leaves as (rows, value)."""
    shrink = lambda x: math.copysign(max(abs(x) - p["l1"], 0), x)
    worth = lambda part: shrink(sum(g[i] for i in part)) ** 2 / (sum(h[i] for i in part) + p["l2"])

    def best(part, depth):
        found = (1e-12, None)
        if depth == p["depth"]:
            return found
        for f in range(len(FEATURES)):
            for bin_ in range(width):
                left = [i for i in part if rows[i][f] <= bin_]
                right = [i for i in part if rows[i][f] > bin_]
                if min(len(left), len(right)) < p["min_rows"] or min(sum(h[i] for i in left), sum(h[i] for i in right)) < 1e-3:
                    continue
                gain = worth(left) + worth(right) - worth(part)
                if gain > found[0] + 1e-12:
                    found = (gain, (left, right))
        return found

    whole = list(range(len(rows)))
    leaves = [(whole, 0, best(whole, 0))]
    while len(leaves) < p["leaves"]:
        top = max(leaves, key=lambda leaf: leaf[2][0])
        if top[2][1] is None:
            break
        leaves.remove(top)
        leaves += [(part, top[1] + 1, best(part, top[1] + 1)) for part in top[2][1]]
    return [(part, -p["rate"] * shrink(sum(g[i] for i in part)) / (sum(h[i] for i in part) + p["l2"])) for part, _, _ in leaves]


def plain_fit(rows, labels, n_classes, p, width):
    """Probabilities of the fitted rows."""
    counts = [labels.count(c) / len(labels) for c in range(max(n_classes, 2))]
    base = [math.log(c) for c in counts] if n_classes > 1 else [math.log(counts[1] / counts[0])]
    scores = np.tile(np.array(base), (len(rows), 1))
    for _ in range(p["trees"]):
        chance = B.probabilities(scores)
        for c in range(n_classes):
            truth = np.array([float(y == c) if n_classes > 1 else float(y) for y in labels])
            g = chance[:, c] - truth
            h = chance[:, c] * (1 - chance[:, c]) * (n_classes / (n_classes - 1) if n_classes > 1 else 1)
            for part, value in plain_tree(rows, g.tolist(), h.tolist(), p, width):
                scores[part, c] += value
    return B.probabilities(scores)


def test_bins(table):
    edges = B.bin_edges(table, FEATURES, 16)
    assert all(e == sorted(set(e)) and len(e) <= 15 for e in edges) and len(edges[1]) <= 6
    columns = [pa.array([None, math.nan, -math.inf, 2.0, math.inf])]
    assert B.codes_of(columns, [[1.0, 2.0, 3.0]])[:, 0].tolist() == [0, 0, 1, 2, 4]
    assert B.bin_edges(table.limit(0), ["a"], 4) == [[]] and B.bin_edges(table, [], 4) == []


@pytest.mark.parametrize("label, classes", [("label", CLASSES), ("two", ["over"])])
def test_fit_equals_a_plain_one(table, matrix, label, classes):
    stored, edges = matrix
    model = B.fit(stored, label, classes, FEATURES, edges, FEATURES, PARAMS)
    rows = [r for r in stored.collect() if r[label] is not None]
    wanted = plain_fit([list(r["codes"]) for r in rows], [r[label] for r in rows], len(classes), B.DEFAULTS | PARAMS, 17)
    names = [f"p{i}" for i in range(len(classes))]
    got = {r["id"]: [r[n] for n in names] for r in B.predict(table, model, names, step=37).collect()}
    assert len(got) == 400
    for r, p in zip(rows, wanted, strict=True):
        assert got[r["id"]] == pytest.approx(p.tolist(), abs=1e-9)
    leaves = model.trees[model.trees["feature"] < 0].groupby(["class", "round"])["rows"].agg(["size", "sum"])
    assert leaves["size"].max() <= 6 and set(leaves["sum"]) == {len(rows)}


def test_tasks_agree(matrix):
    stored, edges = matrix
    params = PARAMS | {"trees": 2, "rows": 0.8, "columns": 0.7, "seed": 5}
    one = B.fit(stored, "label", CLASSES, FEATURES, edges, FEATURES, params)
    more = B.fit(stored, "label", CLASSES, FEATURES, edges, FEATURES, params | {"task_rows": 150}, slots=3)
    same = ["round", "class", "node", "feature", "bin", "left", "right", "rows"]
    assert one.trees[same].equals(more.trees[same]) and one.base == pytest.approx(more.base)
    assert np.allclose(one.trees["value"], more.trees["value"])
    assert one.trees.groupby(["class", "round"])["rows"].sum().max() < 387  # not all rows in a round


def test_bounded_rows_and_bad_input(matrix):
    stored, edges = matrix
    few = B.fit(stored, "two", ["over"], FEATURES, edges, FEATURES, PARAMS | {"most_rows": 100})
    assert 50 < few.trees.groupby("round")["rows"].sum().iloc[0] < 150
    with pytest.raises(ValueError, match="no labelled rows"):
        B.fit(stored.where("false"), "two", ["over"], FEATURES, edges, FEATURES, PARAMS)
    with pytest.raises(ValueError, match="unknown boosting parameters"):
        B.fit(stored, "two", ["over"], FEATURES, edges, FEATURES, {"maxIter": 3})
    alone = B.fit(stored, "two", ["over"], FEATURES, edges, FEATURES, PARAMS | {"min_rows": 300})
    assert set(alone.trees["feature"]) == {-1}  # nothing to split: one leaf a tree


def test_held_out_loss_is_no_worse_than_spark_ml(spark):
    """Equal rounds, depth, rate, enough rounds for both; only complete rows, as Spark ML asks."""
    table = spark.createDataFrame(made_rows(1500, 9), "id long, a double, b double, c double, label int").na.drop()
    table = cut_lineage(table.withColumn("two", (F.col("label") == 0).cast("double")))
    train, held = table.where("id % 4 > 0"), table.where("id % 4 = 0")
    edges = B.bin_edges(train, FEATURES, 32)
    keep = {"two": F.col("two").cast("int"), "key": F.col("id")}
    params = {"trees": 50, "rate": 0.1, "depth": 4, "leaves": 12, "min_rows": 5, "bins": 32}
    model = B.fit(cut_lineage(B.binned(train, FEATURES, edges, keep)), "two", ["over"], FEATURES, edges, FEATURES, params)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="x")
    spark_ml = GBTClassifier(labelCol="two", featuresCol="x", maxIter=50, stepSize=0.1, maxDepth=4, minInstancesPerNode=5, seed=1)
    other = spark_ml.fit(assembler.transform(train)).transform(assembler.transform(held)).select("two", vector_to_array("probability")[1].alias("p"))

    def loss(df):
        p = F.greatest(F.least("p", F.lit(1 - 1e-9)), F.lit(1e-9))
        return df.agg(F.avg(-F.when(F.col("two") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]

    assert loss(B.predict(held, model, ["p"])) <= loss(other) * 1.02
