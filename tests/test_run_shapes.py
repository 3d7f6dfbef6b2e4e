"""Components and clean-up over runs against the kernels over whole images."""

import numpy as np
import pytest

from maskwright.functions import kernels
from maskwright.operators import dense, run_shapes, runs


def frame(spark, h, w, n=6, seed=3):
    rng = np.random.default_rng(seed)
    data = [(i, h, w, (rng.integers(1, 4, h * w) * (rng.random(h * w) < 0.03 * (i + 1))).tolist()) for i in range(n)]
    spiral = np.zeros((21, 600), int)  # one component over several blocks of columns
    spiral[::4, :] = 1
    for i, r in enumerate(range(0, 20, 4)):
        spiral[r : r + 4, 599 * (i % 2 == 0)] = 1
    data.append((99, 21, 600, spiral.ravel().tolist()))
    return spark.createDataFrame(data, "img long, h int, w int, mask array<short>")


def sorted_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_components(spark):
    masks = frame(spark, 13, 300)
    columns = "img", "k", "first_r", "first_c", "n", "sum_r", "sum_c"
    assert sorted_rows(run_shapes.run_components(runs.runs_of(masks)), *columns) == sorted_rows(dense.component_rows(masks), *columns)


@pytest.mark.parametrize("threshold", [0.0, 0.1])
def test_postprocessing(spark, threshold):
    masks = frame(spark, 15, 31).filter("img < 99")
    got = run_shapes.postprocessed(runs.runs_of(masks), masks, threshold)
    want = dense.map_masks(masks, lambda s: kernels.postprocess_classes(s, threshold))
    assert sorted_rows(runs.to_pixels(got), "img", "r", "c", "k") == sorted_rows(dense.to_pixels(want).filter("k > 0"), "img", "r", "c", "k")


def test_holes_null_images_and_empty_tables(spark):
    ring = np.zeros((14, 14), int)
    ring[1:13, 1:13] = 2
    ring[3:11, 3:11] = 0  # dilation leaves 4 x 4 of it and its corners
    small = ring.copy()
    small[4:10, 4:10] = 2
    small[6:8, 6:8] = 0
    data = [(None, 14, 14, ring.ravel().tolist()), (1, 14, 14, small.ravel().tolist()), (2, 3, 3, [0] * 9)]
    masks = spark.createDataFrame(data, "img long, h int, w int, mask array<short>")
    got = runs.to_pixels(run_shapes.postprocessed(runs.runs_of(masks), masks, 0.0)).collect()
    want = dense.to_pixels(dense.map_masks(masks, lambda s: kernels.postprocess_classes(s, 0.0))).filter("k > 0").collect()
    key = lambda rows: sorted((r.img is None, r.img or 0, r.r, r.c, r.k) for r in rows)
    assert key(got) == key(want) and {r.img for r in got} == {None, 1}
    none = masks.limit(0)
    assert run_shapes.postprocessed(runs.runs_of(none), none).count() == 0 and run_shapes.run_components(runs.runs_of(none)).count() == 0
