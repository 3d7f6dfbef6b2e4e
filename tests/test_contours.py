"""Contours of whole stacks, walked together, against those of single masks."""

import numpy as np
import pytest

from maskwright.functions import kernels as K


@pytest.mark.parametrize("shape", [(20, 23, 0.3), (20, 23, 0.6), (7, 9, 0.5), (1, 5, 0.5), (3, 1, 0.5), (2, 2, 0.5), (40, 31, 0.1)])
def test_stacks_equal_single_masks(shape):
    h, w, share = shape
    stack = np.random.default_rng(1).random((60, h, w)) < share
    stack[0], stack[1] = False, True
    bounds, points = K.longest_contours(stack)
    assert [points[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [K.longest_contour(m).tolist() for m in stack]
    which, bounds, points = K.stack_contours(stack)
    got = [(i, points[a:b].tolist()) for i, a, b in zip(which.tolist(), bounds, bounds[1:])]
    assert got == [(i, x.tolist()) for i, m in enumerate(stack) for x in K.external_contours(m)]


def test_empty_stacks():
    assert K.longest_contours(np.zeros((0, 3, 4), bool))[1].shape == (0, 2)
    assert K.longest_contours(np.zeros((2, 3, 4), bool))[1].tolist() == [[0, 0], [4, 0], [4, 3], [0, 3]] * 2
    assert [len(x) for x in K.stack_contours(np.zeros((2, 3, 4), bool))] == [0, 1, 0]


def test_disk_by_rows():
    stack = np.random.default_rng(2).random((9, 11, 13)) < 0.05
    assert (K.dilate(stack) == K.dilate(stack, list(K.DISK2))).all()
    for line in (stack[:, :1], stack[:, :, :1]):
        assert (K.dilate(line) == K.dilate(line, list(K.DISK2))).all()


def test_polygons_of_classes_walk_borders_together(monkeypatch):
    from maskwright.operators import dense

    monkeypatch.setattr(K, "external_contours", None)  # one mask at a time, and once too slow
    rng = np.random.default_rng(3)
    stack = (rng.integers(1, 3, (50, 32, 40)) * (rng.random((50, 32, 40)) < 0.01)).astype(np.int16)
    got = dense._border_rows(0.0, False)(np.arange(50), stack)
    assert len(got["points"]) == len(got["img"]) > 100 and {*got["id"]} == {1, 2}
    assert all(list(got["ord"][(got["img"] == i) & (got["id"] == 1)]) == list(range(n)) for i, n in enumerate(np.bincount(got["img"][got["id"] == 1], minlength=50)))


def test_borders_apart_need_no_shuffle(spark, sf):
    from maskwright.operators import dense
    from maskwright.plans.queries import QUERIES

    data = [(1, "a", [0, 0, 0, 3, 4, 3, 4, 0]), (2, None, [5, 5]), (None, "b", [2, -1, 4, 1, 2, 3, 2, 1, 9]), (3, "c", []), (4, "d", None), (5, "e", [1, 1, 1, 4, 1, 1])]
    polygons = spark.createDataFrame(data, "img long, name string, points array<int>")
    for swapped in (False, True):
        want = dense.walked(polygons, ["img", "name"], swapped)
        got = dense.walked(polygons, ["img", "name"], swapped, apart=True)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "hashpartitioning" not in QUERIES["b11_border_pixels"](spark, sf)._jdf.queryExecution().executedPlan().toString()
