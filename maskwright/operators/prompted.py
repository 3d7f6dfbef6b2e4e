"""Masks from the logits of prompted segmentation: one map for each of a row's own texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

_SHAPE = ["lh", "lw", "h", "w"]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, logits = batch.column("ids"), batch.column("logits")
        flat, offsets = logits.flatten().to_numpy(zero_copy_only=False), logits.offsets.to_numpy() - logits.offsets[0].as_py()
        texts = np.diff(ids.offsets.to_numpy())
        shapes = np.stack([texts, *(batch.column(c).to_numpy() for c in _SHAPE)], 1)
        for shape in np.unique(shapes, axis=0):
            n, lh, lw, h, w = shape.tolist()
            rows = np.flatnonzero((shapes == shape).all(1))
            for part in np.array_split(rows, max(1, len(rows) * n * h * w // 4_000_000)):
                if (np.diff(offsets)[part] != n * lh * lw).any() or not n:
                    raise ValueError("logits must be texts x lh x lw numbers, with a text at least")
                stack = np.stack([flat[offsets[i] : offsets[i + 1]] for i in part]).astype(float).reshape(len(part) * n, lh, lw)
                at = kernels.bilinear(stack, h, w).reshape(len(part), n, h * w).argmax(1)
                own = np.stack([ids[int(i)].values.to_numpy(zero_copy_only=False) for i in part])
                mask = np.take_along_axis(own, at, 1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column("img").take(pa.array(part)), pa.array(np.full(len(part), h), pa.int32()), pa.array(np.full(len(part), w), pa.int32()), pa.array(list(mask), pa.list_(pa.int16()))], names=["img", "h", "w", "mask"])


def prompted_masks(rows: DataFrame, label2id: dict[str, int]) -> DataFrame:
    """img, h, w, mask from rows (img, texts, logits: texts x lh x lw numbers, lh, lw, h, w).

    Each text's map is interpolated to h x w (bilinear, pixel centres), each pixel takes
    the text with the greatest logit (ties: the first) and through it a label id; texts
    that stand there twice count as two. A text without an id raises, and so does a row
    without texts. Rows of any shapes may be mixed; an empty table gives no rows.
    """
    known = F.create_map(*[F.lit(x) for p in label2id.items() for x in p])
    one = lambda t: F.when(known[t].isNull(), F.raise_error(F.concat(F.lit("unknown text "), F.coalesce(t, F.lit("null")))).cast("int")).otherwise(known[t])
    kind = rows.schema["img"].dataType.simpleString()
    return rows.select("img", F.transform("texts", one).alias("ids"), F.col("logits").cast("array<double>").alias("logits"), *[F.col(c).cast("int").alias(c) for c in _SHAPE]).mapInArrow(_run, f"img {kind}, h int, w int, mask array<short>")
