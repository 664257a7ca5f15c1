"""A fit reads all rows, in one task or several."""

import numpy as np
from pyspark.sql import functions as F

from duelframe.operators import boosting as B
from duelframe.session import cut_lineage

PARAMS = {"trees": 1, "leaves": 4, "bins": 8, "min_rows": 5}


def test_no_row_is_left_out_by_default(spark):
    """Before, a fit of more than a million rows took a sample of them."""
    n = 1_060_000
    table = spark.range(n).selectExpr("cast(id % 97 as double) as a", "cast(id % 97 > 40 as int) as two", "xxhash64(id) as key")
    edges = [[float(x) for x in range(12, 97, 12)]]
    matrix = cut_lineage(B.binned(table, ["a"], edges, {"two": F.col("two"), "key": F.col("key")}))
    model = B.fit(matrix, "two", ["over"], ["a"], edges, ["a"], PARAMS | {"task_rows": 2 * n})
    assert model.trees["rows"].sum() == n
    positive = sum(len(range(r, n, 97)) for r in range(41, 97))
    assert np.isclose(model.base[0], np.log(positive / (n - positive)))


def test_many_and_few_rows_add_up_alike(monkeypatch):
    rng = np.random.default_rng(3)
    codes, n = rng.integers(0, 9, (700, 5)).astype(np.uint8), 700
    labels, keys = (codes[:, 0] > rng.integers(0, 9, n)).astype(np.int16), rng.integers(0, 2**62, n).astype(np.uint64)
    p = B.DEFAULTS | PARAMS | {"trees": 3, "rows": 0.8, "columns": 0.6}
    fit = lambda: B._Fit(codes, keys, lambda x: x, False, 8, p).run(labels, 1)
    found = fit()
    monkeypatch.setattr(B, "FEW_ROWS", 64)
    assert fit() == found


def test_exchange_in_portions(spark, monkeypatch):
    table = spark.range(900).selectExpr("cast(id % 97 as double) as a", "cast(id % 97 > 40 as int) as two", "xxhash64(id) as key")
    edges = [[float(x) for x in range(12, 97, 12)]]
    matrix = cut_lineage(B.binned(table, ["a"], edges, {"two": F.col("two"), "key": F.col("key")}))
    fit = lambda **more: B.fit(matrix, "two", ["over"], ["a"], edges, ["a"], PARAMS | {"leaves": 2} | more, slots=2)
    one = fit()
    monkeypatch.setattr(B, "EXCHANGE_BYTES", 256)
    two = fit(task_rows=500)
    assert one.trees["rows"].tolist() == two.trees["rows"].tolist() and np.allclose(one.trees["value"], two.trees["value"])
