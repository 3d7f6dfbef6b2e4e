"""Runs dealt out to cells: images larger than a cell, and joins that small files must not turn into broadcasts."""

import numpy as np
import pytest

from maskwright.functions import kernels
from maskwright.operators import cells, dense, run_shapes, runs, tiles


def large(spark, h=300, w=530):
    rng = np.random.default_rng(5)
    sparse = rng.integers(1, 3, h * w) * (rng.random(h * w) < 0.35)
    ring = np.zeros((h, w), int)
    ring[250:260, 10:520] = ring[10:290, 250:262] = 7
    one = np.ones(h * w, int)
    return spark.createDataFrame([(i, h, w, x.ravel().tolist()) for i, x in enumerate((sparse, ring, one))], "img long, h int, w int, mask array<short>")


def rows(df):
    return sorted(tuple(r) for r in df.select("img", "k", "first_r", "first_c", "n", "sum_r", "sum_c").collect())


def test_components_over_several_cells(spark):
    masks = large(spark)
    want = rows(dense.component_rows(masks))
    assert rows(run_shapes.run_components(runs.runs_of(masks))) == want
    assert rows(tiles.tiled_components(tiles.tiles_of(masks, 64, 100))) == want


def test_classes_over_each_other(spark):
    data = [(1, 0, 0, 5, 1), (1, 0, 3, 9, 2), (1, 1, 4, 4, 1), (1, 0, 5, 7, 1), (None, 300, 255, 256, 3)]
    df = spark.createDataFrame(data, "img long, r int, c0 int, c1 int, k int")
    got = {tuple(r) for r in run_shapes.run_components(df).collect()}
    assert got == {(1, 1, 0, 0, 9, 1, 32), (1, 2, 0, 3, 7, 0, 42), (None, 3, 300, 255, 2, 600, 511)}


def test_a_cell_of_several_tasks_is_one(spark):
    df = spark.createDataFrame([(1, r, 0, 299, 1) for r in range(40)], "img long, r int, c0 int, c1 int, k int").repartition(7)
    assert cells.packed(df).count() > 2
    assert rows(run_shapes.run_components(df)) == [(1, 1, 0, 0, 12_000, 300 * 780, 40 * 44_850)]


def test_components_of_small_images_meet_nothing(spark, sf):
    """Components within a cell cost no join, as a broadcast of what small files hold once took more than a driver has."""
    from maskwright.plans.queries import QUERIES

    for name in ("b1_tiled_components", "b1_run_components"):
        assert "Join" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def smeared(spark, h=290, w=540):
    """Noise, borders of cells between a component's parts, and holes over them."""
    rng = np.random.default_rng(8)
    noise = rng.integers(1, 4, h * w) * (rng.random(h * w) < 0.02)
    lines = np.zeros((h, w), int)
    lines[20:270:40, 30:500] = 2
    lines[100:200, 255] = lines[250:262, 300:310] = 1
    holes = np.zeros((h, w), int)
    holes[200:280, 200:300] = 3
    for r, c in ((252, 253), (250, 270), (210, 250), (253, 240)):  # what dilation leaves of them: 4 x 1 to 2 x 6, over the cells' borders
        holes[r : r + 6 + c % 2, c : c + 6 + r % 5] = 0
    far = np.zeros((h, w), int)
    far[254:259, 100:420] = far[10:280, 510:515] = 5
    return spark.createDataFrame([(i, h, w, x.ravel().tolist()) for i, x in enumerate((noise, lines, holes, far))], "img long, h int, w int, mask array<short>")


@pytest.mark.parametrize("threshold", [0.0, 0.0002, 0.01])
def test_clean_up_over_several_cells(spark, threshold):
    masks = smeared(spark)
    got = runs.to_pixels(run_shapes.postprocessed(runs.runs_of(masks), masks, threshold))
    want = dense.to_pixels(dense.map_masks(masks, lambda s: kernels.postprocess_classes(s, threshold))).filter("k > 0")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_clean_up_of_small_images_meets_sizes_alone(spark, sf):
    from maskwright.plans.queries import QUERIES

    assert "Join" not in QUERIES["b2_postprocess_runs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
