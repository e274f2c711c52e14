"""Exact quantiles against numpy, with ties, skew, nulls and few values a row; ways out against plain walks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from roadloom.operators import reach as R
from roadloom.operators.quantiles import exact_quantiles

WANTED = {"p0": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "p100": 1.0, "upper": None}


def fixture():
    rng = random.Random(3)
    groups = {
        "plain": [rng.gauss(0, 1) for _ in range(700)], "ties": [5.0] * 400 + [rng.choice([4.0, 5.0, 6.0, 7.5]) for _ in range(300)], "skew": [10.0 ** rng.uniform(-200, 200) for _ in range(500)],
        "one": [3.25], "two": [1.0, 2.0], "same": [7.0] * 300, None: [float(i % 90) for i in range(360)], "nulls": [],
    }
    rows = [(k, v, "x") for k, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    return groups, rows


@pytest.mark.parametrize("most", [40, 4096])
def test_quantiles_equal_numpy(spark, most):
    groups, rows = fixture()
    df = spark.createDataFrame(rows, "g string, val double, n string").repartition(4)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "val", WANTED, most=most, ranges=8).collect()}
    assert set(got) == {k for k, vs in groups.items() if vs}
    for k, row in got.items():
        vs = sorted(groups[k])
        assert (row.n, row.low, row.high, row.upper) == (len(vs), vs[0], vs[-1], vs[len(vs) // 2])
        assert [row[n] for n, p in WANTED.items() if p is not None] == pytest.approx([np.quantile(vs, p) for p in WANTED.values() if p is not None], rel=1e-12)


def test_whole_column_and_no_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert exact_quantiles(df, [], "v", {"q": 0.25}).collect() == [(11, 0.0, 10.0, 2.5)]
    assert exact_quantiles(df.where("v < 0"), [], "v", {"q": 0.25}).count() == 0


def test_ways_out_of_a_few_nodes(spark):
    then = {i: i + 1 for i in range(40)} | {100: 7, 101: 40, 200: 201}
    hops = {n: 40 - n for n in range(41)} | {100: 34, 101: 1, 200: 1, 201: 0}
    steps = spark.createDataFrame([(n, h, then.get(n)) for n, h in hops.items()], "node long, hops long, next long")
    starts = [0, 0, 39, 40, 100, 101, 200, 999]
    got = {r.node: r.path for r in R.ways_out(spark.createDataFrame([(n,) for n in starts], "node long"), steps).collect()}

    def way(n):
        return [] if n not in then else [then[n], *way(then[n])]

    assert got == {n: way(n) for n in set(starts) - {999}}
    assert R.ways_out(steps.select("node").limit(0), steps).count() == 0
