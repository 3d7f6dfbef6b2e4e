"""Training-batch preparation as projections over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, images, maskstats, raster, rows

#: Height and width of augmented images.
SIZE = (512, 512)


def segmentation(pixels: DataFrame, height: int, width: int, num_labels: int | None = None, aug: bool = False) -> DataFrame:
    """img, r, c, k, target_size: mirrored at random if ``aug``, classes from ``num_labels`` on made background."""
    if aug:
        pixels = rows.flip(pixels, height, width, rows.coin(F.col("img"), "h"), rows.coin(F.col("img"), "v"))
    if num_labels is not None:
        pixels = maskstats.clamp_classes(pixels, num_labels)
    return pixels.select("img", "r", "c", "k", F.struct(F.lit(height).alias("h"), F.lit(width).alias("w")).alias("target_size"))


def image_to_text(pixels: DataFrame, captions: DataFrame, height: int, width: int, aug: bool = False) -> DataFrame:
    """Images mirrored if ``aug``; captions pass through. Dense masks (img, h, w, mask) stay rows of an image each."""
    if "mask" in pixels.columns:
        out = dense.mirrored(pixels, rows.coin(F.col("img"), "h"), rows.coin(F.col("img"), "v")) if aug else dense.given(pixels)
    else:
        out = segmentation(pixels, height, width, None, aug).drop("target_size")
    return out.join(captions.hint("merge"), "img")  # made from a small table, but not small


def multi_label(images: DataFrame, num_labels: int, reduce_labels: bool = True, label_column: str = "labels") -> DataFrame:
    return images.withColumn(label_column, rows.multi_hot(F.col(label_column), num_labels, reduce_labels))


def detection(images: DataFrame) -> DataFrame:
    """image_id, annotations of rows (image_id, category_id, area, bbox lists)."""
    return images.select("image_id", rows.coco_annotations(F.col("image_id"), F.col("category_id"), F.col("area"), F.col("bbox")).alias("annotations"))


def panoptic(polygons: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The instance mask's pixels and the classes of its instances."""
    return raster.instance_mask(polygons, height, width), raster.instance_classes(polygons)


def semantic_from_polygons(polygons: DataFrame, height: int, width: int, keep: list[int] | None = None) -> DataFrame:
    """Pixels of the semantic mask of the kept categories."""
    if keep is not None:
        polygons = rows.keep_categories(polygons, keep)
    return raster.semantic_mask(polygons, height, width)


def _target(samples: DataFrame):
    return F.col("bbox_subfig_save_size") if "bbox_subfig_save_size" in samples.columns else F.array("h", "w")


def segmentation_images(samples: DataFrame, num_labels: int | None = None, aug: bool = False, size: tuple[int, int] = SIZE) -> DataFrame:
    """Rows (img, h, w, image, mask): images with channels first, masks without classes from ``num_labels`` on, target_size."""
    out = images.prepare(samples, size if aug else None)
    if num_labels is not None:
        out = out.withColumn("mask", F.transform("mask", lambda k: F.when(k < num_labels, k).otherwise(F.lit(0).cast(out.schema["mask"].dataType.elementType))))
    return out.withColumn("target_size", _target(out))


def image_to_text_images(samples: DataFrame, aug: bool = False, size: tuple[int, int] = SIZE) -> DataFrame:
    """Rows (img, h, w, image, caption): only images change, and keep their channels last."""
    return images.prepare(samples, size if aug else None, channels_first=False)


def multi_label_images(samples: DataFrame, num_labels: int, aug: bool = False, reduce_labels: bool = True, label_column: str = "labels", size: tuple[int, int] = SIZE) -> DataFrame:
    """Rows (img, h, w, image, labels): images with channels first, labels as lists of zeros and ones."""
    return multi_label(images.prepare(samples, size if aug else None), num_labels, reduce_labels, label_column)


def detection_images(samples: DataFrame, aug: bool = False, size: tuple[int, int] = SIZE, noise: float = 0.2) -> DataFrame:
    """Rows (image_id, h, w, image, category_id, area, bbox): image (channels last, blue first) and annotations; boxes move with the image, areas stay.

    Noise has a variance of 10 to 50, where the other transforms have 10 to 20.
    """
    out = images.prepare(samples, size if aug else None, channels_first=False, bgr=True, noise=noise, variance=(10.0, 50.0), key="image_id")
    return out.select("image_id", "h", "w", "image", rows.coco_annotations(F.col("image_id"), F.col("category_id"), F.col("area"), F.col("bbox")).alias("annotations"))


def panoptic_images(samples: DataFrame, aug: bool = False, size: tuple[int, int] = SIZE, noise: float = 0.2) -> DataFrame:
    """Rows (img, h, w, image, points, category_id): images with channels first, instance masks, the map from instance to class."""
    out = images.prepare(raster.with_mask(samples), size if aug else None, noise=noise)
    classes = F.transform("category_id", lambda x, i: F.struct(i + 1, x + 1))
    classes = F.map_from_entries(F.concat(F.array(F.struct(F.lit(0), F.lit(0))), classes))
    return out.withColumns({"instance_id_to_semantic_id": classes, "target_size": _target(out)}).drop("points", "category_id")


def semantic_images(samples: DataFrame, aug: bool = False, keep: list[int] | None = None, size: tuple[int, int] = SIZE, noise: float = 0.3) -> DataFrame:
    """Rows (img, h, w, image, points, category_id) with a category left: images with channels first, masks of the kept categories, each of 1 to their number mapped to itself."""
    if keep is not None:
        samples = rows.keep_categories(samples, keep)
    out = images.prepare(raster.with_mask(samples.filter(F.size("category_id") > 0), semantic=True), size if aug else None, noise=noise)
    same = F.transform(F.sequence(F.lit(1), F.size(F.array_distinct("category_id"))), lambda i: F.struct(i, i.alias("same")))
    return out.withColumns({"instance_id_to_semantic_id": F.map_from_entries(same), "target_size": _target(out)}).drop("points", "category_id")
