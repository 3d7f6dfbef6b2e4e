"""Statistics of class masks over the pixel relation (img, r, c, k), or over runs (img, r, c0, c1, k) of equal pixels in its stead.

Counts of one image shrink to a row a class in the task that expands the image,
so each of these takes one small shuffle on the image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import CELLS


def _span(rows: DataFrame) -> tuple[Column, Column]:
    """First and last column of a row of pixels or runs."""
    return (F.col("c0"), F.col("c1")) if "c0" in rows.columns else (F.col("c"), F.col("c"))


def _pixels(rows: DataFrame) -> Column:
    first, last = _span(rows)
    return last - first + 1


def _within(rows: DataFrame, start: int, end: int | None = None) -> Column:
    """How many pixels of a row lie in the columns from ``start`` on, before ``end``."""
    first, last = _span(rows)
    last = last if end is None else F.least(last, F.lit(end - 1))
    return F.greatest(F.lit(0), last - F.greatest(first, F.lit(start)) + 1)


def drop_background(pixels: DataFrame) -> DataFrame:
    return pixels.filter(F.col("k") != 0)


def clamp_classes(pixels: DataFrame, num_labels: int) -> DataFrame:
    """Class ids from ``num_labels`` on become background."""
    return pixels.withColumn("k", F.when(F.col("k") >= num_labels, F.lit(0)).otherwise(F.col("k")))


def area_ratio(pixels: DataFrame) -> DataFrame:
    """img, k, n, area of the classes present, background included."""
    n = pixels.groupBy("img", "k").agg(F.sum(_pixels(pixels)).alias("n"))
    return n.withColumn("area", F.col("n") / F.sum("n").over(W.partitionBy("img")))


def _class_counts(pixels: DataFrame, classes: Sequence[int], **more: Column) -> DataFrame:
    per = [F.sum(F.when(F.col("k") == k, _pixels(pixels)).otherwise(0)).alias(f"n{k}") for k in classes]
    return pixels.groupBy("img").agg(F.sum(_pixels(pixels)).alias("total"), *per, *[c.alias(n) for n, c in more.items()])


def area_all(pixels: DataFrame, classes: Sequence[int], all_id: bool = True) -> DataFrame:
    """img, k, n, area for every class of the vocabulary but background; absent classes have 0, or are left out."""
    wanted = [k for k in classes if k != 0]
    rows = _class_counts(pixels, wanted).select("img", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in wanted])).alias("x"))
    rows = rows.select("img", "x.k", "x.n", (F.col("x.n") / F.col("total")).alias("area"))
    return rows if all_id else rows.filter("n > 0")


def _cells(rows: DataFrame, height: int, width: int) -> list[Column]:
    """Pixels in each of the nine cells, n0 to n8."""
    row, w = F.expr(f"r DIV {height // 3}"), width // 3
    return [F.sum(F.when(row == i // 3, _within(rows, i % 3 * w, (i % 3 + 1) * w)).otherwise(0)).alias(f"n{i}") for i in range(9)]


def class_statistics(pixels: DataFrame, classes: Sequence[int], height: int, width: int) -> DataFrame:
    """img, k, area, w, h, area_cell of every class of the vocabulary but background, from one pass over the pixels; 0 where a class is absent."""
    if min(height, width) < 3:
        raise ValueError("a mask side is below 3 pixels")
    first, last = _span(pixels)
    extent = [F.min("r").alias("least_r"), F.max("r").alias("most_r"), F.min(first).alias("least_c"), F.max(last).alias("most_c")]
    each = pixels.groupBy("img", "k").agg(F.sum(_pixels(pixels)).alias("n"), *extent, *_cells(pixels, height, width))
    found = F.struct((F.col("most_c") - F.col("least_c") + 1).alias("w"), (F.col("most_r") - F.col("least_r") + 1).alias("h"), first_max(F.array(*[f"n{i}" for i in range(9)])).alias("area_cell"))
    image = each.groupBy("img").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", found.alias("x"))))).alias("of"))
    wanted = F.array(*[F.lit(k) for k in classes if k != 0])
    rows = image.select("img", "total", "of", F.explode(wanted).alias("k")).select("img", "total", "k", F.col("of")[F.col("k")].alias("s"))
    zero = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    return rows.select("img", "k", (zero("s.n", 0) / F.col("total")).alias("area"), zero("s.x.w", 0).alias("w"), zero("s.x.h", 0).alias("h"), zero("s.x.area_cell", 0).alias("area_cell"))


def bounding_box(pixels: DataFrame) -> DataFrame:
    """img, k, x, y, w, h of each class present but background."""
    first, last = _span(pixels)
    box = drop_background(pixels).groupBy("img", "k").agg(F.min(first).alias("x"), F.min("r").alias("y"), F.max(last).alias("x1"), F.max("r").alias("y1"))
    return box.select("img", "k", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"))


def first_max(values: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def nine_cell(pixels: DataFrame, height: int, width: int, return_num: int = 1) -> DataFrame:
    """img, k, cell (and cell2): the cells of a 3 x 3 grid with most pixels of the class; ties to the lower; rows and columns beyond 3 x (side div 3) are ignored."""
    if min(height, width) < 3:
        raise ValueError("a mask side is below 3 pixels")
    if return_num not in (1, 2):
        raise ValueError("return_num is 1 or 2")
    n = drop_background(pixels).groupBy("img", "k").agg(*_cells(pixels, height, width))
    out = n.select("img", "k", F.array(*[f"n{i}" for i in range(9)]).alias("cells")).withColumn("cell", first_max(F.col("cells")))
    if return_num == 2:
        rest = F.transform("cells", lambda x, i: F.when(i == F.col("cell"), F.lit(0)).otherwise(x))
        out = out.withColumn("cell2", first_max(rest))
    return out.drop("cells")


def cell_name(cell: Column) -> Column:
    return F.get(F.array(*map(F.lit, CELLS)), cell)


def six_region(pixels: DataFrame, height: int, width: int, by_class: bool = True) -> DataFrame:
    """img (and k), region: 0 left, 1 right, 2 middle column, 3 up, 4 down, 5 middle row; the last third has the remainder.

    Without ``by_class``, class ids are summed as values over the whole mask.
    """
    h, w = height // 3, width // 3
    length = _pixels(pixels)
    rows_in = lambda x: F.when(x, length).otherwise(0)
    r = F.col("r")
    inside = [_within(pixels, 0, w), _within(pixels, 2 * w), _within(pixels, w, 2 * w), rows_in(r < h), rows_in(r >= 2 * h), rows_in((r >= h) & (r < 2 * h))]
    value, keys = (F.lit(1), ["img", "k"]) if by_class else (F.col("k"), ["img"])
    rows = drop_background(pixels) if by_class else pixels
    sums = rows.groupBy(*keys).agg(*[F.sum(x * value).alias(f"s{i}") for i, x in enumerate(inside)])
    return sums.select(*keys, first_max(F.array(*[f"s{i}" for i in range(6)])).alias("region"))


def merge_max(*layers: DataFrame) -> DataFrame:
    """Per pixel, the greatest class of several masks."""
    rows = layers[0]
    for layer in layers[1:]:
        rows = rows.unionByName(layer)
    return rows.groupBy("img", "r", "c").agg(F.max("k").alias("k"))


def binary_masks(pixels: DataFrame, names: DataFrame) -> DataFrame:
    """img, label_id, label_name, r, c, v (0 or 1): a mask for each class present, background included; an unknown class raises."""
    present = pixels.groupBy("img").agg(F.collect_set("k").alias("ks"))
    rows = pixels.join(present, "img").select("img", "r", "c", F.explode("ks").alias("label_id"), F.col("k")).select("img", "label_id", "r", "c", (F.col("k") == F.col("label_id")).cast("float").alias("v"))
    return strict_lookup(rows, names, "label_id")


def if_small(dim: DataFrame, most: int = 10_000) -> DataFrame:
    """A dimension with a hint to send it to all executors, if it has no more rows than that."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def strict_lookup(rows: DataFrame, dim: DataFrame, key: str, name: str = "label_name") -> DataFrame:
    """Joins ``name`` of a dimension; a key that it lacks raises."""
    out = rows.join(if_small(dim.select(key, name)), key, "left")
    return out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(name)))


def segmentation_metrics(pairs: DataFrame) -> DataFrame:
    """img and its class-averaged metrics, for (img, k, p) pixels of truth and prediction; a class in neither scores 1."""
    classes = pairs.select("img", "k", "p").groupBy("img", "k", "p").agg(F.count("*").alias("n"))
    each = classes.select("img", "n", F.explode(F.array_distinct(F.array("k", "p"))).alias("label"), "k", "p")
    per = each.groupBy("img", "label").agg(
        F.sum(F.when((F.col("k") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") == F.col("label"), F.col("n")).otherwise(0)).alias("truth"),
        F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
    )
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    per = per.withColumns({"precision": share(F.col("tp"), F.col("said")), "recall": share(F.col("tp"), F.col("truth")), "iou": share(F.col("tp"), F.col("truth") + F.col("said") - F.col("tp"))})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    per = per.withColumn("f1", f1)
    return per.groupBy("img").agg(
        (F.sum("tp") / F.sum("truth")).alias("pixel_accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("iou").alias("iou"), (F.sum(F.col("truth") * F.col("iou")) / F.sum("truth")).alias("fw_iou"),
    )
