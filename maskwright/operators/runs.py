"""Class masks as runs: img, r, c0, c1 (both inside), k, one row for each stretch of equal pixels of a mask's row.

Runs hold what pixels hold in far fewer rows; the statistics of ``maskstats`` take either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import given, stacks


def stretches(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mask, row, first column, last column, value) of each run of a stack (n, h, w)."""
    n, h, w = stack.shape
    begins = np.ones(stack.shape, bool)
    begins[:, :, 1:] = stack[:, :, 1:] != stack[:, :, :-1]
    at = np.flatnonzero(begins)
    long = np.diff(at, append=stack.size)
    return at // (h * w), at // w % h, at % w, at % w + long - 1, stack.ravel()[at]


def runs_of(masks: DataFrame) -> DataFrame:
    """The runs of dense masks (img, h, w, mask), background included, in the task that reads them.

    Rows with a null mask or side are left out; a null img stays. Empty masks have no run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stack in stacks(batch):
                image, *found = stretches(stack)
                yield pa.RecordBatch.from_arrays([batch.column("img").take(pa.array(rows[image])), *[pa.array(x.astype(np.int32)) for x in found]], names=["img", "r", "c0", "c1", "k"])

    kind = masks.schema["img"].dataType.simpleString()
    return given(masks).mapInArrow(run, f"img {kind}, r int, c0 int, c1 int, k int")


def to_pixels(runs: DataFrame, name: str = "k") -> DataFrame:
    """img, r, c and the runs' value, a row for each pixel."""
    return runs.select("img", "r", F.explode(F.sequence("c0", "c1")).alias("c"), name)


def merge_max(*layers: DataFrame) -> DataFrame:
    """Runs of the greatest class of several masks at each place; places that no layer has are left out.

    Runs meet by the row of their image, whose bounds part them: each part takes the
    greatest class over it. Neighbouring parts of one class are laid together.
    """
    rows = layers[0].select("img", "r", "c0", "c1", "k")
    for layer in layers[1:]:
        rows = rows.unionByName(layer.select("img", "r", "c0", "c1", "k"))
    row = rows.groupBy("img", "r").agg(F.collect_list(F.struct("c0", "c1", "k")).alias("of"))  # an image's row: as many runs as it has pixels for each layer, at most

    none = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2)
            first, last, value = (of.flatten().field(i).to_numpy().astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(of.offsets.to_numpy()))
            wide = int(last.max(initial=0)) + 2
            a, b = row * wide + first, row * wide + last + 1
            cuts = np.unique(np.concatenate([a, b]))
            start = np.searchsorted(cuts, a)
            parts = np.searchsorted(cuts, b) - start  # how many parts a run covers
            at = np.repeat(start - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
            most = np.full(len(cuts), none)  # a row's last bound begins nothing
            np.maximum.at(most, at, np.repeat(value, parts))
            begins = np.flatnonzero(np.diff(most, prepend=none) != 0)
            begins, ends = begins[most[begins] != none], np.append(begins, len(cuts))[1:][most[begins] != none]
            owner = pa.array(cuts[begins] // wide)
            whole = (cuts[begins] % wide, cuts[ends] % wide - 1, most[begins]) if len(begins) else (begins,) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(x.astype(np.int32)) for x in whole]], names=["img", "r", "c0", "c1", "k"])

    kind = rows.schema["img"].dataType.simpleString()
    return row.mapInArrow(run, f"img {kind}, r int, c0 int, c1 int, k int")
