"""Determinants of blocks larger than one task takes."""

from __future__ import annotations

import numpy as np
import pytest

from stillwater.operators import matrix

ENTRIES = "grp bigint, row bigint, col bigint, value double"


def entries(grp, a):
    return [(grp, int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]


def test_blocks_beyond_one_task(spark, monkeypatch):
    """By rows, by columns (a kinetic matrix without its first row and column), a singular one, and a small one."""
    monkeypatch.setattr(matrix, "MOST", 30)
    draw = np.random.default_rng(1)
    rates = np.where(draw.random((70, 70)) < 0.08, draw.random((70, 70)), 0.0) + np.diag(np.ones(69), 1) + np.diag(np.ones(69), -1)
    np.fill_diagonal(rates, 0.0)
    by_rows = np.diag(rates.sum(1) + draw.random(70)) - rates
    kinetic = rates.T - np.diag(rates.sum(1))
    minor, small = kinetic[1:, 1:], draw.random((5, 5)) - 0.5
    rows = entries(1, by_rows) + entries(2, minor) + entries(3, kinetic) + entries(4, small)
    got = {r["grp"]: r for r in matrix.determinants(spark.createDataFrame(rows, ENTRIES)).collect()}
    for grp, a in ((1, by_rows), (2, minor), (4, small)):
        sign, log = np.linalg.slogdet(a)
        assert got[grp]["n"] == len(a) and got[grp]["sign"] == sign and abs(got[grp]["log"] - log) < 1e-9
    assert got[3]["log"] == float("-inf") or got[3]["log"] < got[2]["log"] - 30


def test_a_large_sparse_block(spark):
    """10,000 rows, in a product form: a product of two-by-two blocks, coupled one way."""
    n = 10_000
    d = spark.range(n).selectExpr("1L AS grp", "id AS row", "id AS col", "CASE WHEN id % 2 = 0 THEN 3.0D ELSE 4.0D END AS value")
    pair = spark.range(n).selectExpr("1L AS grp", "id AS row", "CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS col", "-1.0D AS value")
    one_way = spark.range(n - 2).selectExpr("1L AS grp", "id AS row", "id + 2 AS col", "-0.5D AS value").where("row % 2 = 0")
    got = matrix.determinants(d.unionByName(pair).unionByName(one_way)).first()
    assert got["n"] == n and got["sign"] == 1.0 and abs(got["log"] / (n / 2 * np.log(11.0)) - 1) < 1e-12


def test_others_are_refused(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MOST", 2)
    for a in (np.ones((3, 3)), np.eye(3) - 0.9 * (1 - np.eye(3)), np.diag([1.0, 0.0, 1.0])):
        with pytest.raises(ValueError):
            matrix.determinants(spark.createDataFrame(entries(1, a), ENTRIES)).collect()
