import numpy as np
import pytest

from maskwright.operators import dense, tiles


def rows(df):
    return sorted(tuple(r) for r in df.select("img", "k", "first_r", "first_c", "n", "sum_r", "sum_c").collect())


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (4, 5), (64, 64)])
def test_tiles_equal_the_whole_image(spark, shape):
    rng = np.random.default_rng(2)
    data = [(i, 13, 17, rng.integers(0, 3, 13 * 17).tolist()) for i in range(12)]
    spiral = np.zeros((21, 21), int)  # one component through all tiles
    spiral[::4, :] = 1
    for i, r in enumerate(range(0, 20, 4)):
        spiral[r : r + 4, 20 * (i % 2 == 0)] = 1
    data.append((99, 21, 21, spiral.ravel().tolist()))
    df = spark.createDataFrame(data, "img long, h int, w int, mask array<short>")
    assert rows(tiles.tiled_components(tiles.tiles_of(df, *shape))) == rows(dense.component_rows(df))


def test_far_places_missing_tiles_and_null_images(spark):
    data = [(1, 0, 0, 1, 2, [1, 1]), (1, 0, 2, 1, 2, [1, 0]), (1, 1_000_000, 2_000_000_000, 1, 1, [1]), (None, 0, 0, 1, 1, [2]), (None, 1, 1, 1, 1, [2]), (2, 5, 5, 1, 1, [0])]
    df = spark.createDataFrame(data, "img long, r0 int, c0 int, h int, w int, mask array<short>")
    got = {tuple(r) for r in tiles.tiled_components(df).collect()}
    assert got == {(1, 1, 0, 0, 3, 0, 3), (1, 1, 1_000_000, 2_000_000_000, 1, 1_000_000, 2_000_000_000), (None, 2, 0, 0, 2, 1, 1)}
    assert tiles.tiled_components(df.limit(0)).count() == 0
