"""Polygons to masks.

The rule: a pixel (c, r) is inside where the ray to its right crosses the edges an
odd number of times, or where it lies on an edge. Rows are (img, points, category_id)
with parallel lists of flat polygons, one row for each image; each image is painted in
the task that reads it, polygon by polygon over its own bounding box, without a
shuffle. A row without polygons raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import polygon_crossings
from .runs import stretches, to_pixels


#: Flat polygons as (x, y) arrays, their categories, height and width to a painted mask.
Painter = Callable[[list[np.ndarray], list[int], int, int], np.ndarray]


def _instances(polygons: list[np.ndarray], kinds: list[int], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), np.int32)
    for i, points in enumerate(polygons, 1):
        r, c, cross, on = polygon_crossings(points, height, width)
        box = out[r : r + cross.shape[0], c : c + cross.shape[1]]
        box[(cross % 2 == 1) | on] = i
    return out


def _categories(add: int) -> Painter:
    def paint(polygons: list[np.ndarray], kinds: list[int], height: int, width: int) -> np.ndarray:
        out = np.zeros((height, width), np.int32)
        for kind in sorted(set(kinds)):
            crossed, on_edge = np.zeros((height, width), np.int32), np.zeros((height, width), bool)
            for points in [p for p, k in zip(polygons, kinds, strict=True) if k == kind]:
                r, c, cross, on = polygon_crossings(points, height, width)
                box = slice(r, r + cross.shape[0]), slice(c, c + cross.shape[1])
                crossed[box] += cross
                on_edge[box] |= on
            out[(crossed % 2 == 1) | on_edge] = max(kind + add, 0)
        return out

    return paint


def _mask_of(points: list[list[int]], kinds: list[int], height: int, width: int, paint: Painter) -> np.ndarray:
    if not points:
        raise ValueError("an image has no polygons")
    return paint([np.array(p, np.int64)[: len(p) // 2 * 2].reshape(-1, 2) for p in points], kinds, height, width)


def _painted(height: int, width: int, name: str, paint: Painter):
    """Batches of (img, points, category_id) to the runs above 0 of what ``paint`` makes of an image's polygons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                parent, found = [], []
                for i, (points, kinds) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    mask = _mask_of(points, kinds, height, width, paint)
                    _, *line = stretches(mask[None])
                    line = np.stack(line)[:, line[-1] > 0]
                    parent.append(np.full(line.shape[1], i))
                    found.append(line)
                owner = part.column(0).take(pa.array(np.concatenate(parent)))
                yield pa.RecordBatch.from_arrays([owner, *map(pa.array, np.concatenate(found, axis=1).astype(np.int32))], names=["img", "r", "c0", "c1", name])

    return run


def _paint(rows: DataFrame, height: int, width: int, name: str, paint: Painter) -> DataFrame:
    kind = rows.schema["img"].dataType.simpleString()
    return rows.select("img", "points", "category_id").mapInArrow(_painted(height, width, name, paint), f"img {kind}, r int, c0 int, c1 int, {name} int")


def instance_runs(rows: DataFrame, height: int, width: int) -> DataFrame:
    """img, r, c0, c1, inst (from 1): the covered pixels as runs; where polygons overlap the highest instance wins."""
    return _paint(rows, height, width, "inst", _instances)


def instance_mask(rows: DataFrame, height: int, width: int) -> DataFrame:
    """img, r, c, inst: ``instance_runs`` pixel by pixel."""
    return to_pixels(instance_runs(rows, height, width), "inst")


def instance_classes(rows: DataFrame, background: bool = True) -> DataFrame:
    """img, inst, class = category + 1; with 0 -> 0 for the background."""
    each = rows.select("img", F.posexplode("category_id").alias("i", "category_id")).select("img", (F.col("i") + 1).alias("inst"), (F.col("category_id") + 1).alias("class"))
    return each.unionByName(rows.select("img", F.lit(0).alias("inst"), F.lit(0).alias("class"))) if background else each


def semantic_runs(rows: DataFrame, height: int, width: int, background_as_class0: bool = True) -> DataFrame:
    """img, r, c0, c1, k: the polygons of a category are filled together, so that their overlaps cancel; the highest category wins.

    With ``background_as_class0`` a category is painted as it is, so category 0
    vanishes; else as one more than it is.
    """
    return _paint(rows, height, width, "k", _categories(0 if background_as_class0 else 1))


def semantic_mask(rows: DataFrame, height: int, width: int, background_as_class0: bool = True) -> DataFrame:
    """img, r, c, k: ``semantic_runs`` pixel by pixel."""
    return to_pixels(semantic_runs(rows, height, width, background_as_class0))


def _masked(names: list[str], paint: Painter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                given = (part.column(n).to_pylist() for n in ("points", "category_id", "h", "w"))
                masks = [_mask_of(*x, paint).ravel() for x in zip(*given, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(masks, pa.list_(pa.int32()))], names=[*names, "mask"])

    return run


def with_mask(rows: DataFrame, semantic: bool = False, background_as_class0: bool = True) -> DataFrame:
    """All columns of ``rows`` (with h and w) and ``mask``, flat: instances as in ``instance_mask`` or categories as in ``semantic_mask``."""
    paint = _categories(0 if background_as_class0 else 1) if semantic else _instances
    names = [c for c in rows.columns if c != "mask"]
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(_masked(names, paint), T.StructType([*rows.schema.fields, T.StructField("mask", T.ArrayType(T.IntegerType()))]))


def group_polygons(rows: DataFrame) -> DataFrame:
    """img, category_id, ord, polygons: polygons of each category in order, categories by first appearance."""
    each = rows.select("img", F.posexplode(F.arrays_zip("points", "category_id")).alias("i", "z"))
    grouped = each.groupBy("img", F.col("z.category_id").alias("category_id")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("z.points").alias("p")))).alias("x"))
    return grouped.select("img", "category_id", F.get("x", F.lit(0))["i"].alias("ord"), F.transform("x", lambda y: y["p"]).alias("polygons"))
