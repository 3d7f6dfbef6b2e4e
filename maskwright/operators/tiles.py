"""Components of images of any size, from tiles.

A tile is a dense part of a class mask: img, r0, c0 (its upper left pixel), h, w, mask.
Tiles shrink to their runs, which meet those of other tiles in the cells of their image:
small tiles are laid together before components are looked for, and the graph over
components has edges at the cells' borders alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dense import given, stacks
from .run_shapes import run_components
from .runs import stretches


def tiles_of(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles of ``height`` x ``width`` pixels, smaller ones at the lower and right edges, of dense masks (img, h, w, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("img")
            for rows, stack in stacks(batch):
                for r0 in range(0, stack.shape[1], height):
                    for c0 in range(0, stack.shape[2], width):
                        part = stack[:, r0 : r0 + height, c0 : c0 + width]
                        n, (h, w) = len(part), part.shape[1:]
                        numbers = [pa.array(np.full(n, x), pa.int32()) for x in (r0, c0, h, w)]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *numbers, pa.array(list(part.reshape(n, -1)), pa.list_(pa.int16()))], names=["img", "r0", "c0", "h", "w", "mask"])

    kind = masks.schema["img"].dataType.simpleString()
    return given(masks).mapInArrow(run, f"img {kind}, r0 int, c0 int, h int, w int, mask array<short>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        corner = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("r0", "c0")]
        for rows, stack in stacks(batch):
            tile, r, c0, c1, k = stretches(stack)
            owner = rows[tile]
            r, c0, c1 = corner[0][owner] + r, corner[1][owner] + c0, corner[1][owner] + c1
            yield pa.RecordBatch.from_arrays([batch.column("img").take(pa.array(owner)), *[pa.array(x.astype(np.int32)) for x in (r, c0, c1, k)]], names=["img", "r", "c0", "c1", "k"])


def tiled_components(tiles: DataFrame) -> DataFrame:
    """img, k, first_r, first_c, n, sum_r, sum_c: one row for each 8-connected component of a foreground class, as of the whole images.

    Tiles may be of any shapes and need not cover their image; they must not overlap. A
    null img is an image like any other; tiles of null mask must be left out before. An
    empty table gives no rows.
    """
    kind = tiles.schema["img"].dataType.simpleString()
    return run_components(tiles.select("img", "r0", "c0", "h", "w", "mask").mapInArrow(_runs, f"img {kind}, r int, c0 int, c1 int, k int"))
