"""DataFrame operators over dense masks, against loops over pixels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_kernels import flood, masks

from maskwright.functions import kernels as K
from maskwright.operators import dense, raster


def frame(spark, found, extra=""):
    """found: (img, mask[, label])"""
    rows = [(i, *m.shape, [int(x) for x in m.ravel()], *rest) for i, m, *rest in found]
    return spark.createDataFrame(rows, "img long, h int, w int, mask array<short>" + extra)


def outer_pixels(mask):
    """For each outermost component, its pixels that touch the outside with a side, by the component's first pixel."""
    m = np.pad(mask, 1)
    outside = flood(m, K.FOUR)[0, 0]
    found = {}
    for part in {id(p): p for p in flood(m, K.EIGHT).values()}.values():
        first = min(part)
        if m[first] and (first[0] - 1, first[1]) in outside:
            found[first] = {(c - 1, r - 1) for r, c in part if any((r + dr, c + dc) in outside for dr, dc in K.FOUR + [(0, 1), (1, 0)])}
    return [found[k] for k in sorted(found)]


def walked(line):
    """All pixels of a border whose straight lines are given by their ends."""
    out = {tuple(line[0])}
    for (x, y), (u, v) in zip(line, np.roll(line, -1, 0), strict=True):
        n = max(abs(u - x), abs(v - y))
        assert n == 0 or {abs(u - x), abs(v - y)} <= {0, n}
        out |= {(x + (u - x) * k // n, y + (v - y) * k // n) for k in range(n + 1)} if n else set()
    return {(int(a), int(b)) for a, b in out}


@settings(max_examples=80, deadline=None)
@given(masks)
def test_external_contours(stack):
    for m in stack:
        got = [walked(x) for x in K.external_contours(m)]
        assert got == outer_pixels(m)


def test_known_contours():
    m = np.zeros((9, 12), bool)
    m[1:8, 1:8] = True
    m[3:6, 3:6] = False
    m[4, 4] = True  # inside a hole
    m[2, 10] = True
    assert [x.tolist() for x in K.external_contours(m)] == [[[1, 1], [1, 7], [7, 7], [7, 1]], [[10, 2]]]
    assert K.external_contours(np.zeros((3, 3), bool)) == []


def test_every_blob_has_its_polygon(spark):
    m = np.zeros((40, 40), np.int16)
    m[5:9, 5:9], m[25:30, 25:30], m[5:8, 30:33] = 1, 1, 2
    got = {(r.img, r.id, r.ord): r.points for r in dense.semantic_polygons(frame(spark, [(7, m), (8, np.zeros((4, 5)))])).collect()}
    assert set(got) == {(7, 1, 0), (7, 1, 1), (7, 2, 0)}
    clean = K.postprocess(m[None] == 1, 0)[0] > 0
    assert [got[7, 1, k] for k in (0, 1)] == [x.ravel().tolist() for x in K.external_contours(clean)]
    results = frame(spark, [(7, (m == 1) * 255, "云"), (7, m == 2, "unknown"), (7, m == 0, "background")], ", label string")
    swapped = {(r.category_id, r.ord): r.points for r in dense.result_polygons(results, {"云": 3}).collect()}
    assert swapped == {(2, k): [v for p in np.reshape(got[7, 1, k], (-1, 2)) for v in p[::-1].tolist()] for k in (0, 1)}


def test_instance_maps_are_by_image(spark):
    m = np.zeros((20, 20), np.int16)
    m[3:6, 3:6], m[12:15, 12:15] = 1, 2
    maps = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 8), (2, 2, 9)], "img long, id int, class int")
    got = dense.instance_polygons(frame(spark, [(1, m), (2, m)]), maps).collect()
    assert sorted((r.img, r.id, r.category_id) for r in got) == [(1, 1, 4), (1, 2, 5), (2, 1, 7), (2, 2, 8)]
    assert all(r.points == K.longest_contour(K.fill_holes(K.dilate(m[None] == r.id))[0]).ravel().tolist() for r in got)
    with pytest.raises(Exception, match="no class for instance"):
        dense.instance_polygons(frame(spark, [(1, m)]), maps.filter("id = 1")).collect()


def test_ids_that_no_pixel_has(spark):
    m = np.zeros((20, 23), np.int16)
    m[3:6, 3:6], m[12:15, 12:15], m[0, 22] = 2, 4, -1
    maps = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 4, 9)], "img long, id int, class int")
    nothing = [(2, np.zeros((4, 5), np.int16)), (3, np.full((4, 5), -1, np.int16))]
    got = {(r.img, r.id): r for r in dense.instance_polygons(frame(spark, [(1, m), *nothing]), maps).collect()}
    assert {k: (r.present, r.category_id) for k, r in got.items()} == {(1, 1): (False, None), (1, 2): (True, 5), (1, 3): (False, None), (1, 4): (True, 8)}
    assert got[1, 1].points == got[1, 3].points == [0, 0, 23, 0, 23, 20, 0, 20]


def test_merge_and_resize(spark):
    rng = np.random.default_rng(4)
    one, two = rng.random((12, 13)) < 0.2, rng.random((12, 13)) < 0.1
    results = frame(spark, [(1, one, "a"), (1, two, "b"), (1, ~one, "background")], ", label string")
    got = dense.semantic_merge(results, {"a": 4, "b": 2}).first()
    want = np.maximum((K.postprocess(one[None])[0] > 0) * 4, (K.postprocess(two[None])[0] > 0) * 2)
    assert np.array(got.mask).reshape(12, 13).tolist() == want.tolist()
    image = frame(spark, [(1, one * 9)])
    got = dense.resize_bilinear(image, 7, 20).first()
    assert (got.h, got.w) == (7, 20) and np.allclose(np.array(got.mask).reshape(7, 20), K.bilinear(one[None] * 9.0, 7, 20)[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 14), st.integers(-4, 12)), min_size=1, max_size=7))
def test_polygon_crossings(points):
    r0, c0, cross, on = K.polygon_crossings(np.array(points), 9, 11)
    for r in range(cross.shape[0]):
        for c in range(cross.shape[1]):
            n, edge = 0, False
            for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
                y, x = r + r0, c + c0
                side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
                n += (y1 > y) != (y2 > y) and (side > 0 if y2 > y1 else side < 0)
                edge |= side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
            assert (cross[r, c], on[r, c]) == (n, edge)


def test_no_polygons_raise(spark):
    df = spark.createDataFrame([(1, [], [])], "img long, points array<array<int>>, category_id array<int>")
    for op in (raster.instance_mask, raster.semantic_mask):
        with pytest.raises(Exception, match="no polygons"):
            op(df, 5, 5).collect()
    df = spark.createDataFrame([(1, [[0, 0, 3, 0, 3, 3, 0, 3], [1, 1, 2, 1, 2, 2, 1, 2]], [2, 2])], "img long, points array<array<int>>, category_id array<int>")
    assert raster.semantic_mask(df, 5, 5).agg(F.sum("k")).first()[0] == 2 * 16  # on its edges a polygon covers, though it cancels inside
