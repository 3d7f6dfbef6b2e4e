"""Images (key, h, w, image): bytes of height x width x three channels, row by row, changed in the task that reads them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from .rows import coin

#: Rows that one outgoing batch holds at most.
SLICE = 64


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(h, w, channel) bytes to another size, bilinear, halves up (within 1e-6, so that float errors don't decide)."""
    out = kernels.bilinear(np.moveaxis(image, -1, 0).astype(float), height, width)
    return np.moveaxis(np.floor(out + 0.500001), 0, -1).astype(np.uint8)


def _noisy(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    draws = np.random.Generator(np.random.Philox(key=seed % (1 << 64))).normal(0, sigma, image.shape)
    return np.clip(np.rint(image + draws), 0, 255).astype(np.uint8)


def _prepared(names: list[str], size: tuple[int, int] | None, channels_first: bool, bgr: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                batch = whole.slice(s, SLICE)
                h, w, right, down, sigma, seed = (batch.column(n).to_pylist() for n in ("h", "w", "_right", "_down", "_sigma", "_seed"))
                columns = {n: batch.column(n) for n in names}

                def turned(x: np.ndarray, i: int, right=right, down=down) -> np.ndarray:
                    x = x[:, ::-1] if right[i] else x
                    return x[::-1] if down[i] else x

                images = []
                for i, data in enumerate(batch.column("image").to_pylist()):
                    if data is None:
                        images.append(None)
                        continue
                    x = np.frombuffer(data, np.uint8).reshape(h[i], w[i], 3)
                    x = x[:, :, ::-1] if bgr else x
                    if size:
                        x = turned(resized(x, *size), i)
                        x = _noisy(x, sigma[i], seed[i]) if sigma[i] else x
                    images.append(np.ascontiguousarray(np.moveaxis(x, -1, 0) if channels_first else x).tobytes())
                columns["image"] = pa.array(images, pa.binary())
                if size and "mask" in columns:
                    masks = []
                    for i, data in enumerate(columns["mask"]):
                        x = data.values.to_numpy(zero_copy_only=False).reshape(h[i], w[i]) if data.is_valid else None
                        masks.append(None if x is None else turned(x[np.arange(size[0]) * h[i] // size[0]][:, np.arange(size[1]) * w[i] // size[1]], i).ravel())
                    columns["mask"] = pa.array(masks, columns["mask"].type)
                if size:
                    columns |= {"h": pa.array([size[0]] * batch.num_rows, pa.int32()), "w": pa.array([size[1]] * batch.num_rows, pa.int32())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return run


def prepare(rows: DataFrame, size: tuple[int, int] | None = None, channels_first: bool = True, bgr: bool = False, noise: float = 0.0, variance: tuple[float, float] = (10.0, 20.0), seed: int = 0, key: str = "img") -> DataFrame:
    """All columns of ``rows`` with images of the order asked for; with ``size`` augmented.

    Augmenting is: to (height, width) = ``size``, mirrored from left to right and from
    top to bottom with a chance of a half each, and Gaussian noise of a variance drawn
    from ``variance`` with chance ``noise``. Columns ``mask`` (flat, by the nearest pixel)
    and ``bbox`` (lists of x, y, width, height) move along if they are there. Draws are
    hashes of the key and ``seed``, so that a task run again gives the same. Null images,
    masks and boxes stay null. Rows hold an image each: on large ones, lower
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    of = F.col(key)
    unit = F.pmod(F.xxhash64(of, F.lit(seed), F.lit("variance")), F.lit(1 << 31)) / float(1 << 31)
    sigma = F.when(coin(of, "noise", noise), F.sqrt(F.lit(variance[0]) + (variance[1] - variance[0]) * unit)).otherwise(0.0)
    drawn = {"_right": coin(of, "h"), "_down": coin(of, "v"), "_sigma": sigma, "_seed": F.xxhash64(of, F.lit(seed))}
    names = rows.columns
    rows = rows.withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int")}).withColumns(drawn)
    if size and "bbox" in names:
        down, right = size[0] / F.col("h"), size[1] / F.col("w")

        def moved(b):
            x, y, w, h = (F.get(b, F.lit(i)) * f for i, f in enumerate((right, down, right, down)))
            return F.array(F.when(F.col("_right"), size[1] - x - w).otherwise(x), F.when(F.col("_down"), size[0] - y - h).otherwise(y), w, h)

        rows = rows.withColumn("bbox", F.transform("bbox", moved))
    return rows.mapInArrow(_prepared(names, size, channels_first, bgr), T.StructType([rows.schema[n] for n in names]))
