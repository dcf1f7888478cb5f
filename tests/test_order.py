"""Places, running totals and order statistics against plain Python; the area that moved frames have in common against every pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.operators import batch, depth, geometry
from rasterfold.operators.order import numbered, order_statistic, running


def test_places_with_a_hot_null_key_and_ties(spark):
    rows = [(None if i % 3 else i % 5, (i * 7919) % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = {r["i"]: r["n"] for r in numbered(df, ["v", "i"], "n", ["k"]).collect()}
    for key in {k for k, _, _ in rows}:
        mine = sorted((v, i) for k, v, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(len(mine)))
    places = {r["i"]: r["n"] for r in numbered(df, ["v", "i"], "n").collect()}
    assert [places[i] for _, i in sorted((v, i) for _, v, i in rows)] == list(range(600))


def test_running_total_and_empty_table(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(500)], "i int, w int")
    got = {r["i"]: r["s"] for r in running(df, ["i"], "s", F.col("w")).collect()}
    assert got == {i: sum(j % 4 for j in range(i)) for i in range(500)}
    assert running(df.limit(0), ["i"], "s").collect() == []
    assert order_statistic(df.limit(0), "w", lambda n: n - 1, ["i"]).collect() == []


def test_order_statistic_counts_repeats(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(701)], "i int, v double")
    want = sorted(float(i % 7) for i in range(701))
    for at in (0, 350, 700):
        assert [r["stat"] for r in order_statistic(df, "v", lambda n, at=at: F.least(F.lit(at), n - 1), ["i"]).collect()] == [want[at]]


def test_noise_floor_without_and_with_a_stack_agree(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(1, y, x, float(rng.random())) for y in range(20) for x in range(30)], "stack int, y int, x int, low double")
    assert depth.noise_floor(df.drop("stack"), [], 30).collect()[0][0] == depth.noise_floor(df, ["stack"], 30).collect()[0][1]


def test_runs_of_folders(spark):
    paths = ["a/1.png", "a/2.png", "b/1.png", "a/3.png", "a/4.png", "1.png", "b/2.png"]
    df = spark.createDataFrame(list(enumerate(paths)), "pos int, path string")
    of = lambda d: [r["stack"] for r in d.orderBy("pos").collect()]
    assert of(batch.split_dir(df, "pos", consecutive=True)) == [0, 0, 1, 2, 2, 3, 4]
    assert of(batch.split_dir(df, "pos")) == [0, 0, 1, 0, 0, 2, 1]


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "spline4x4", "lanczos3"])
def test_common_area_covers_and_cannot_grow(spark, kernel):
    h, w, rng = 20, 30, np.random.default_rng(5)
    margin = 0 if kernel == "nearest" else geometry.KERNELS[kernel][0] // 2
    stacks = {s: [geometry.Transform(*(rng.normal(0, t) for t in (0.03, 0.03)), 1 + rng.normal(0, 0.03), *(rng.normal(0, t) for t in (0.1,)), 1 + rng.normal(0, 0.02), rng.normal(0, 0.02), *rng.normal(0, 0.1, 2)).inverse(h, w) for _ in range(3)] for s in range(6)}
    stacks[6], stacks[7] = [geometry.Transform().inverse(h, w)], [geometry.Transform(xoff=2.0).inverse(h, w)]
    df = spark.createDataFrame([(s, m) for s, ms in stacks.items() for m in ms], "stack int, m array<double>")
    got = {r["stack"]: (r["x"], r["y"], r["w"], r["h"]) for r in geometry.common_area(df, h, w, kernel, ["stack"]).collect()}
    ys, xs = np.mgrid[:h, :w]
    for s, ms in stacks.items():
        ok = np.ones((h, w), bool)
        for m in ms if s != 6 else []:
            d = m[6] * xs + m[7] * ys + m[8]
            sx, sy = (m[0] * xs + m[1] * ys + m[2]) / d, (m[3] * xs + m[4] * ys + m[5]) / d
            ok &= (sx >= margin) & (sx <= w - 1 - margin) & (sy >= margin) & (sy <= h - 1 - margin)
        sizes = [(b - a) * (d - c) for c in range(h) for d in range(c + 1, h + 1) for a in range(w) for b in range(a + 1, w + 1) if ok[c:d, a:b].all()] if ok.any() else []
        x, y, across, down = got[s]
        assert (across * down == max(sizes) and ok[y : y + down, x : x + across].all()) if sizes else got[s] == (0, 0, w, h)
