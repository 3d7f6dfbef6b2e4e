"""Runs dealt out to cells: squares of ``SIDE`` pixels that part images of any size.

An image's cells are keyed by (img, row of cells, column of cells). A cell's runs travel
as one row of short lists, laid together in the task that reads them; of a cell that lies
in several tasks several rows meet. Within a cell runs are painted, so a task holds as
many pixels as a batch of cells has, whatever an image's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a cell.
SIDE = 256
#: Pixels of the stacks that are painted at once, about.
PIXELS = 1 << 20
#: Runs that are packed at once.
RUNS = 1 << 18
_LISTS = [("r", pa.int16()), ("c0", pa.int16()), ("c1", pa.int16()), ("k", pa.int32())]


def _numbers(column: pa.Array) -> np.ndarray:
    """A number for each value of a column, null being a value like any other."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): the values from each of ``first`` on, ``size`` of them."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def _packed(reach: int):
    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        r, c0, c1, k = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
        low, left = (np.maximum(x - reach, 0) // SIDE for x in (r, c0))
        tall, wide = (r + reach) // SIDE - low + 1, (c1 + reach) // SIDE - left + 1
        of, part = spread(np.zeros(len(r), np.int64), tall * wide)
        row, column = low[of] + part // wide[of], left[of] + part % wide[of]
        image = _numbers(batch.column(0))[of]
        order = np.lexsort((column, row, image))
        of, row, column, image = of[order], row[order], column[order], image[order]
        begins = np.ones(len(of), bool)
        begins[1:] = (image[1:] != image[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        at = np.flatnonzero(begins)
        ends = pa.array(np.append(at, len(of)).astype(np.int32))
        corner = column * SIDE
        values = r[of] - row * SIDE, np.maximum(c0[of] - corner, -reach), np.minimum(c1[of] - corner, SIDE + reach - 1), k[of]
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(kind.to_pandas_dtype()))) for v, (_, kind) in zip(values, _LISTS, strict=True)]
        whole = [pa.array(x[at].astype(np.int32)) for x in (row, column)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[at])), *whole, *lists], names=["img", "row", "col", *[n for n, _ in _LISTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:  # an image's runs can lie in several batches
            kept.append(batch)
            n += batch.num_rows
            if n >= RUNS:
                yield pack(pa.concat_batches(kept))
                kept, n = [], 0
        if n:
            yield pack(pa.concat_batches(kept))

    return run


def packed(runs: DataFrame, reach: int = 0) -> DataFrame:
    """img, row, col and lists r, c0, c1, k: the parts of ``runs`` (img, r, c0, c1, k) in each cell and within ``reach`` of it, counted from its first pixel."""
    kind = runs.schema["img"].dataType.simpleString()
    rows = runs.select("img", F.col("r").cast("int"), F.col("c0").cast("int"), F.col("c1").cast("int"), F.col("k").cast("int"))
    return rows.mapInArrow(_packed(reach), f"img {kind}, row int, col int, r array<short>, c0 array<short>, c1 array<short>, k array<int>")


def met(cells: DataFrame) -> DataFrame:
    """All rows of a cell in one task, one after the other."""
    return cells.repartition("img", "row", "col").sortWithinPartitions("img", "row", "col")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that part no cell, with the first row of each cell."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if kept is None else pa.concat_batches([kept, batch])
        at = _first_rows(batch)
        kept = batch.slice(int(at[-1]))
        if at[-1]:
            yield batch.slice(0, int(at[-1])), at[:-1]
    if kept is not None:
        yield kept, np.zeros(1, np.int64)


def _first_rows(batch: pa.RecordBatch) -> np.ndarray:
    key = [_numbers(batch.column(0)), *(batch.column(i).to_numpy() for i in (1, 2))]
    return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in key], axis=0)))


def listed(batch: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cell, r, c0, c1, k) of the runs of a batch whose cells begin at the rows ``first``."""
    lists = [batch.column(n) for n, _ in _LISTS]
    sizes = np.diff(lists[0].offsets.to_numpy())
    cell = np.repeat(np.searchsorted(first, np.arange(batch.num_rows), "right") - 1, sizes)
    return cell, *[x.flatten().to_numpy().astype(np.int64) for x in lists]


def painted(shape: tuple[int, int, int], which: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bool]:
    """A stack with the runs' values, 0 elsewhere, and whether runs of different values lie over each other."""
    n, h, w = shape
    run, at = spread((which * h + r) * w + c0, c1 - c0 + 1)
    flat, value = np.zeros(n * h * w, values.dtype), values[run]
    flat[at] = value
    return flat.reshape(shape), bool((flat[at] != value).any())
