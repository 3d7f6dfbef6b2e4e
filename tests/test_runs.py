"""Runs against the pixels they stand for."""

import numpy as np
import pytest

from maskwright.operators import dense, maskstats, raster, runs


def frame(spark, rng, n=12, h=11, w=14):
    return spark.createDataFrame([(i, h, w, np.repeat(rng.integers(0, 4, h * w), 3)[: h * w].tolist()) for i in range(n)], "img long, h int, w int, mask array<short>")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(tuple(r) for r in df.select(*sorted(a.columns)).collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("shape", [(3, 3), (11, 14), (20, 5)])
def test_statistics_of_runs_are_those_of_pixels(spark, shape):
    h, w = shape
    masks = frame(spark, np.random.default_rng(h), h=h, w=w)
    px, own = dense.to_pixels(masks).cache(), runs.runs_of(masks).cache()
    same(runs.to_pixels(own), px)
    for f in (maskstats.area_ratio, maskstats.bounding_box, lambda x: maskstats.area_all(x, range(5)), lambda x: maskstats.area_all(x, range(5), False), lambda x: maskstats.nine_cell(x, h, w, 2), lambda x: maskstats.six_region(x, h, w), lambda x: maskstats.six_region(x, h, w, False), lambda x: maskstats.class_statistics(x, range(5), h, w)):
        same(f(own), f(px))
    # no run could be longer
    got = sorted(tuple(r) for r in own.collect())
    assert all(not (x[:2] == y[:2] and x[4] == y[4] and x[3] + 1 == y[2]) for x, y in zip(got, got[1:], strict=False))


def test_merging_runs(spark):
    rng = np.random.default_rng(4)
    one, two = frame(spark, rng), frame(spark, rng)
    layers = [runs.runs_of(one), runs.runs_of(two).filter("k > 1")]
    got = runs.merge_max(*layers)
    same(runs.to_pixels(got), maskstats.merge_max(*[runs.to_pixels(x) for x in layers]))
    gaps = [(1, 0, 2, 4, 1), (1, 0, 9, 9, 3), (1, 0, 3, 5, 2), (1, 0, 10, 11, 3), (1, 0, 9, 9, 3), (None, 7, 0, 0, 0)]
    some = spark.createDataFrame(gaps, "img long, r int, c0 int, c1 int, k int")
    assert {tuple(r) for r in runs.merge_max(some).collect()} == {(1, 0, 2, 2, 1), (1, 0, 3, 5, 2), (1, 0, 9, 11, 3), (None, 7, 0, 0, 0)}
    assert runs.merge_max(some.limit(0)).count() == 0


def test_nulls_empty_masks_and_tables(spark):
    data = [(1, 2, 2, [0, 1, 1, 1]), (None, 1, 2, [3, 3]), (2, None, 2, [1, 1]), (3, 1, 1, None), (4, 0, 0, [])]
    df = spark.createDataFrame(data, "img long, h int, w int, mask array<short>")
    assert {tuple(r) for r in runs.runs_of(df).collect()} == {(1, 0, 0, 0, 0), (1, 0, 1, 1, 1), (1, 1, 0, 1, 1), (None, 0, 0, 1, 3)}
    assert runs.runs_of(df.limit(0)).count() == 0
    assert dense.component_rows(df.filter("img IS NOT NULL")).count() == 1


def test_polygons_as_runs(spark):
    rows = spark.createDataFrame([(1, [[1, 1, 4, 1, 4, 3, 1, 3], [3, 2, 8, 2, 8, 2]], [1, 2])], "img long, points array<array<int>>, category_id array<int>")
    got = {tuple(r) for r in raster.semantic_runs(rows, 5, 7).collect()}
    assert got == {(1, 1, 1, 4, 1), (1, 2, 1, 2, 1), (1, 2, 3, 6, 2), (1, 3, 1, 4, 1)}
    same(runs.to_pixels(raster.semantic_runs(rows, 5, 7)), raster.semantic_mask(rows, 5, 7))
