"""Rows made from a small table are many more than its size lets Spark expect: their joins must not send them to the driver."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import dense
from maskwright.plans.queries import QUERIES



@pytest.mark.parametrize("name", ["u2_image_to_text_transform", "b9_instance_polygons", "b9_missing_instances", "e5_mask_to_qa", "e11_coco_annotations", "u1_segmentation_images"])
def test_rows_made_from_a_small_table_are_not_broadcast(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dense_masks_are_mirrored(spark):
    masks = spark.createDataFrame([(i, 2, 3, [1, 2, 3, 4, 5, 6]) for i in range(4)] + [(4, 0, 0, []), (5, 1, 1, None)], "img long, h int, w int, mask array<short>")
    got = {r.img: r.mask for r in dense.mirrored(masks, F.col("img") % 2 == 1, F.col("img") >= 2).collect()}
    assert got == {0: [1, 2, 3, 4, 5, 6], 1: [3, 2, 1, 6, 5, 4], 2: [4, 5, 6, 1, 2, 3], 3: [6, 5, 4, 3, 2, 1], 4: []}
