"""Image transforms by hand-made images and loops."""

import numpy as np
from pyspark.sql import functions as F

from maskwright.operators import images
from maskwright.plans import transforms


def rows(spark, n=40, h=3, w=4):
    made = [(i, h, w, bytes((np.arange(h * w * 3) * 5 + i).astype(np.uint8)), [int(x) for x in np.arange(h * w) + i]) for i in range(n)]
    return spark.createDataFrame([*made, (n, h, w, None, None)], "img long, h int, w int, image binary, mask array<int>"), made


def test_without_augmentation(spark):
    df, made = rows(spark)
    out = {r.img: r for r in transforms.segmentation_images(df, 6).collect()}
    for i, h, w, data, mask in made:
        x = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        assert bytes(out[i].image) == np.moveaxis(x, -1, 0).tobytes()
        assert out[i].mask == [k if k < 6 else 0 for k in mask] and out[i].target_size == [h, w]
    assert out[40].image is None and out[40].mask is None


def test_blue_first_and_boxes_untouched(spark):
    df, made = rows(spark, 3)
    boxed = df.filter("image IS NOT NULL").selectExpr("img AS image_id", "h", "w", "image", "array(1) AS category_id", "array(2.0D) AS area", "array(array(1.0D, 0.0D, 2.0D, 1.0D)) AS bbox")
    for r in transforms.detection_images(boxed).collect():
        x = np.frombuffer(made[r.image_id][3], np.uint8).reshape(3, 4, 3)
        assert bytes(r.image) == x[:, :, ::-1].tobytes() and r.annotations[0].bbox == [1.0, 0.0, 2.0, 1.0]


def test_image_mask_and_box_move_together(spark):
    """A single lit pixel, its mask and its box stay on each other, in all four ways of mirroring."""
    h, w = 5, 7
    image, mask = np.zeros((h, w, 3), np.uint8), np.zeros((h, w), int)
    image[1, 2], mask[1, 2] = 200, 1
    df = spark.createDataFrame([(i, h, w, image.tobytes(), mask.ravel().tolist(), [[2.0, 1.0, 1.0, 1.0]]) for i in range(60)], "img long, h int, w int, image binary, mask array<int>, bbox array<array<double>>")
    places = set()
    for r in images.prepare(df, (10, 14), channels_first=False).collect():
        x, y, bw, bh = (int(v) for v in r.bbox[0])
        m = np.array(r.mask).reshape(10, 14)
        assert m.sum() == bw * bh == 4 and m[y : y + bh, x : x + bw].all()
        lit = np.frombuffer(r.image, np.uint8).reshape(10, 14, 3)[:, :, 0]
        assert lit[y : y + bh, x : x + bw].min() == lit.max() > 0 and (r.h, r.w) == (10, 14)
        places.add((x, y))
    assert places == {(4, 2), (8, 2), (4, 6), (8, 6)}


def test_noise_repeats_and_differs_by_row(spark):
    flat = bytes([128]) * (20 * 20 * 3)
    df = spark.range(300).select(F.col("id").alias("img"), F.lit(20).alias("h"), F.lit(20).alias("w"), F.lit(flat).alias("image"))
    noisy = lambda p, parts: {r.img: bytes(r.image) for r in images.prepare(df.repartition(parts), (20, 20), noise=p).collect()}
    one, two = noisy(0.3, 1), noisy(0.3, 5)
    assert one == two
    changed = [x for x in one.values() if x != flat]
    assert 60 <= len(changed) <= 120 and len(set(changed)) == len(changed)
    spread = [np.frombuffer(x, np.uint8).astype(float).var() for x in changed]
    assert 8 < min(spread) and max(spread) < 24
    assert set(noisy(0.0, 2).values()) == {flat}


def test_polygon_transforms(spark):
    square = [0, 0, 2, 0, 2, 2, 0, 2]
    df = spark.createDataFrame([(1, 4, 5, bytes(60), [square, [3, 3, 4, 3, 4, 3]], [2, 0]), (2, 4, 5, bytes(60), [square], [0])], "img long, h int, w int, image binary, points array<array<int>>, category_id array<int>")
    out = {r.img: r for r in transforms.panoptic_images(df).collect()}
    assert out[1].instance_id_to_semantic_id == {0: 0, 1: 3, 2: 1} and out[2].instance_id_to_semantic_id == {0: 0, 1: 1}
    assert out[1].mask == [1, 1, 1, 0, 0] * 3 + [0, 0, 0, 2, 2]
    kept = transforms.semantic_images(df, keep=[2]).collect()
    assert [r.img for r in kept] == [1] and kept[0].instance_id_to_semantic_id == {1: 1} and kept[0].mask == [2, 2, 2, 0, 0] * 3 + [0] * 5
    assert transforms.semantic_images(df.limit(0)).count() == 0
