"""Components and clean-up of class masks of any size, over runs (img, r, c0, c1, k).

No task holds an image: runs are dealt out to cells, each finds its own components, which
are called by their first pixels, and only what touches a cell's border meets others, over
the graph of touching border pixels. ``sizes`` (img, h, w) has the images' heights and widths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import stored
from . import cells
from .cells import PIXELS, SIDE
from .runs import merge_max, stretches

#: Reach of the disk of radius 2.
DISK = 2
#: Bits of a first pixel's column in a component's name.
COLUMN_BITS = 31


def least_labels(edges: DataFrame) -> DataFrame:
    """img, node, label: the least node of each node's component, for edges (img, a, b); what it points at is shortened in each round.

    Joins are told to sort: small files can hold more rows than a driver could send to all.
    """
    both = stored(edges.select("img", "a", "b").union(edges.select("img", "b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("img", "a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        of = labels.select(F.col("img").alias("_img"), F.col("node").alias("_node"), F.col("label").alias("_label")).hint("merge")
        near = both.join(of, F.col("img").eqNullSafe(F.col("_img")) & (F.col("b") == F.col("_node"))).groupBy("img", F.col("a").alias("node")).agg(F.min("_label").alias("near"))
        near = near.select(F.col("img").alias("_i"), F.col("node").alias("_n"), "near").hint("merge")
        step = labels.join(near, F.col("img").eqNullSafe(F.col("_i")) & (F.col("node") == F.col("_n"))).select("img", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = step.join(of, F.col("img").eqNullSafe(F.col("_img")) & (F.col("label") == F.col("_node")), "left").select("img", "node", "old", F.coalesce(F.least("label", "_label"), "label").alias("label"))
        step = stored(step, "labels")
        labels = step.drop("old")
        if step.filter("label <> old").isEmpty():
            return labels


def _labels_across(border: DataFrame) -> DataFrame:
    """_img, _node, _label of the components of one class that touch others over their cells' borders, from their pixels there (img, k, node, r, c)."""
    # half of the neighbours: each touching pair is met once
    ahead = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reach = border.select("img", "k", F.col("node").alias("a"), "r", "c", F.explode(ahead).alias("d")).select("img", "k", "a", "r", "c", (F.col("r") + F.col("d.dr")).alias("r1"), (F.col("c") + F.col("d.dc")).alias("c1"))
    reach = reach.filter(f"r1 DIV {SIDE} <> r DIV {SIDE} OR c1 DIV {SIDE} <> c DIV {SIDE}").drop("r", "c")
    other = border.select(F.col("img").alias("_img"), F.col("k").alias("_k"), F.col("node").alias("b"), "r", "c").hint("merge")
    touch = F.col("img").eqNullSafe(F.col("_img")) & (F.col("r1") == F.col("r")) & (F.col("c1") == F.col("c")) & (F.col("k") == F.col("_k"))
    found = least_labels(reach.join(other, touch).select(F.struct("img", "k").alias("img"), "a", "b").distinct())
    return found.select(F.col("img.img").alias("_img"), F.col("img.k").alias("_k"), F.col("node").alias("_node"), F.col("label").alias("_label"))


def _labelled(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """``parts`` (img, k, node) with the label of the whole component."""
    own = F.col("img").eqNullSafe(F.col("_img")) & (F.col("k") == F.col("_k")) & (F.col("node") == F.col("_node"))
    return parts.join(labels.hint("merge"), own, "left").withColumn("label", F.coalesce("_label", "node")).drop("_img", "_k", "_node", "_label")


def _on_border(r: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Whether pixels, counted from their cell's first one, lie at a border that another cell may be behind."""
    return ((r == 0) & (row > 0)) | (r == SIDE - 1) | ((c == 0) & (col > 0)) | (c == SIDE - 1)


def _parts(batch: pa.RecordBatch, first: np.ndarray, which: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, k: np.ndarray, h: int, w: int) -> pa.RecordBatch:
    stack, over = cells.painted((len(first), h, w), which, r, c0, c1, k.astype(np.int32))
    if over:  # classes that lie over each other: a layer for each
        kinds, kind = np.unique(k, return_inverse=True)
        own, layer = np.unique(which * len(kinds) + kind, return_inverse=True)
        first = first[own // len(kinds)]
        stack, _ = cells.painted((len(own), h, w), layer, r, c0, c1, k.astype(np.int32))
    n = stack.size
    at = np.flatnonzero(stack.ravel())
    label = (kernels.components(stack) + (np.arange(len(stack)) * h * w)[:, None, None]).ravel()[at]
    r, c, cell = at // w % h, at % w, first[at // (h * w)]
    row, col = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
    size = np.bincount(label, minlength=n)
    seed = np.flatnonzero(size)
    edge = np.flatnonzero(_on_border(r, c, row[cell], col[cell]))
    opened = np.zeros(n, bool)
    opened[label[edge]] = True
    r, c = row[cell] * SIDE + r, col[cell] * SIDE + c
    sums = [np.bincount(label, x, n)[seed].astype(np.int64) for x in (r, c)]
    name = lambda x, own: ((row[own] * SIDE + x // w % h) << COLUMN_BITS) | (col[own] * SIDE + x % w)
    owner = first[seed // (h * w)]
    none = np.zeros(len(edge), np.int64)
    rows = [np.concatenate(x) for x in ((stack.ravel()[seed], stack.ravel()[at[edge]]), (name(seed, owner), name(label[edge], cell[edge])), (size[seed], none), (sums[0], none), (sums[1], none))]
    null = np.arange(len(seed) + len(edge)) < len(seed)
    place = [pa.array(np.concatenate([np.zeros(len(seed), np.int64), x[edge]]), mask=null) for x in (r, c)]
    image = batch.column(0).take(pa.array(np.concatenate([owner, cell[edge]])))
    return pa.RecordBatch.from_arrays([image, pa.array(rows[0].astype(np.int32)), *map(pa.array, rows[1:]), *place, pa.array(np.concatenate([opened[seed], none == 0]))], names=["img", "k", "node", "n", "sum_r", "sum_c", "r", "c", "opened"])


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of components of each cell (r is null), ``opened`` if they touch its border, and of their pixels there."""
    for batch, first in cells.whole_cells(batches):
        which, r, c0, c1, k = cells.listed(batch, first)
        h, w = int(r.max()) + 1, int(c1.max()) + 1
        step = max(1, PIXELS // (h * w))
        for s in range(0, len(first), step):
            part = slice(*np.searchsorted(which, (s, s + step)))
            yield _parts(batch, first[s : s + step], which[part] - s, r[part], c0[part], c1[part], k[part], h, w)


def run_components(runs: DataFrame) -> DataFrame:
    """img, k, first_r, first_c, n, sum_r, sum_c: one row for each 8-connected component of a foreground class.

    A null img is an image like any other. Runs of one class may lie over each other; of
    several classes each has its own components.
    """
    kind = runs.schema["img"].dataType.simpleString()
    dealt = cells.met(cells.packed(runs.filter("k > 0")))
    found = stored(dealt.select("img", "row", "col", "r", "c0", "c1", "k").mapInArrow(_components, f"img {kind}, k int, node long, n long, sum_r long, sum_c long, r long, c long, opened boolean"), "components")
    parts, border = found.filter("r IS NULL"), found.filter("r IS NOT NULL")
    if border.isEmpty():
        out = parts.withColumn("label", F.col("node"))
    else:
        whole = _labelled(parts.filter("opened"), _labels_across(border)).groupBy("img", "k", "label").agg(*[F.sum(x).alias(x) for x in ("n", "sum_r", "sum_c")])
        out = parts.filter("NOT opened").select("img", "k", F.col("node").alias("label"), "n", "sum_r", "sum_c").unionByName(whole)
    # names order as first pixels do, so the least name is the whole component's first pixel
    return out.select("img", "k", F.shiftright("label", COLUMN_BITS).cast("int").alias("first_r"), F.col("label").bitwiseAND(F.lit((1 << COLUMN_BITS) - 1)).cast("int").alias("first_c"), "n", "sum_r", "sum_c")


def _laid(first: np.ndarray, image: pa.Array, kind: int, layer: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind of ``_cleaned``; columns that are not given are null."""
    n = len(layer)
    given = {"img": image.take(pa.array(first[layer])), "kind": pa.array(np.full(n, kind, np.int32))} | {c: pa.array(x.astype(_CLEANED[c].to_pandas_dtype())) for c, x in values.items()}
    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in ({"img": image.type, "kind": pa.int32()} | _CLEANED).items()], names=["img", "kind", *_CLEANED])


_CLEANED = {"r": pa.int32(), "c0": pa.int32(), "c1": pa.int32(), "k": pa.int32(), "node": pa.int64(), "n": pa.int64(), "least": pa.float64()}
#: Kinds of rows: runs of cells that are done, runs to be merged, runs of components that go on beyond their cell, those components, their pixels there.
DONE, MERGED, OPENED, PARTS, BORDER = range(5)


def _cleaned(threshold: float, below: int):
    """Cells (img, row, col, r, c0, c1, k, h, w) with what lies within DISK + ``below`` of them to the kinds of rows.

    A hole of fewer than ``below`` pixels lies within that reach of each of its pixels, so
    each cell finds its holes alone.
    """
    reach = DISK + below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in cells.whole_cells(batches):
            which, r, c0, c1, k = cells.listed(batch, first)
            h, w, row, col = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)[first] for n in ("h", "w", "row", "col"))
            top, left = np.maximum(row * SIDE - reach, 0), np.maximum(col * SIDE - reach, 0)
            tall, wide = np.minimum(h, (row + 1) * SIDE + reach) - top, np.minimum(w, (col + 1) * SIDE + reach) - left
            shape = np.stack([tall, wide, row * SIDE - top, col * SIDE - left, np.minimum(h, (row + 1) * SIDE) - row * SIDE, np.minimum(w, (col + 1) * SIDE) - col * SIDE], 1)
            # from the window's first pixel on, within the image
            r, c0, c1 = r + (row * SIDE - top)[which], np.maximum(c0 + (col * SIDE - left)[which], 0), np.minimum(c1 + (col * SIDE - left)[which], wide[which] - 1)
            inside = (r < tall[which]) & (c0 <= c1)
            order = np.flatnonzero(inside)[np.lexsort((k[inside], which[inside]))]
            which, r, c0, c1, k = (x[order] for x in (which, r, c0, c1, k))
            shapes, same = np.unique(shape, axis=0, return_inverse=True)
            for i, one in enumerate(shapes.tolist()):
                if one[4] <= 0 or one[5] <= 0:  # no pixel of the cell is in the image
                    continue
                alike, step = np.flatnonzero(same.ravel() == i), max(1, PIXELS // (one[0] * one[1]))
                for s in range(0, len(alike), step):
                    some = alike[s : s + step]
                    number = np.full(len(first), -1)
                    number[some] = np.arange(len(some))
                    own = np.flatnonzero(number[which] >= 0)
                    yield from _windows(one, batch.column(0), first[some], [x[some] for x in (row, col, h, w)], [number[which[own]], *[x[own] for x in (r, c0, c1, k)]])

    def _windows(shape: list[int], image: pa.Array, first: np.ndarray, sides: list[np.ndarray], runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tall, wide, top, left, h, w = shape
        row, col, high, broad = sides
        which, r, c0, c1, k = runs
        best, unfinished = np.zeros((len(first), h, w), np.int32), np.zeros(len(first), bool)
        begins = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (k[1:] != k[:-1]))) if len(which) else which
        cell, value = which[begins], k[begins]  # of each layer: the pixels of a class in a cell
        ends, step = np.append(begins, len(which)), max(1, PIXELS // (tall * wide))
        for s in range(0, len(begins), step):
            n = min(step, len(begins) - s)
            own = slice(ends[s], ends[s + n])
            layer = np.repeat(np.arange(n), np.diff(ends[s : s + n + 1]))
            mask, _ = cells.painted((n, tall, wide), layer, r[own], c0[own], c1[own], np.ones(ends[s + n] - ends[s], bool))
            mask = np.ascontiguousarray(kernels.fill_holes(kernels.dilate(mask), below)[:, top : top + h, left : left + w])
            at = np.flatnonzero(mask.ravel())
            of = s + at // (h * w)
            label = (kernels.components(mask.astype(np.int8)) + (np.arange(n) * h * w)[:, None, None]).ravel()[at]
            size = np.bincount(label, minlength=mask.size)
            y, x, least = at // w % h, at % w, threshold * high[cell[of]] * broad[cell[of]]
            edge = _beyond(y, x, row[cell[of]], col[cell[of]], high[cell[of]], broad[cell[of]])
            opened = np.zeros(mask.size, bool)
            opened[label[edge]] = True
            kept = ~opened[label] & (size[label] >= least)
            # layers of a cell ascend by their class, so the greatest is written last
            best.ravel()[cell[of[kept]] * (h * w) + at[kept] % (h * w)] = value[of[kept]]
            if not edge.any():
                continue
            unfinished[cell[of[edge]]] = True
            name = lambda seed, c: ((row[c] * SIDE + seed // w % h) << COLUMN_BITS) | (col[c] * SIDE + seed % w)
            seed = np.flatnonzero(opened)
            part = s + seed // (h * w)
            share = threshold * high[cell[part]] * broad[cell[part]]
            yield _laid(first, image, PARTS, cell[part], k=value[part], node=name(seed, cell[part]), n=size[seed], least=share)
            e = np.flatnonzero(edge)
            c = cell[of[e]]
            yield _laid(first, image, BORDER, c, r=row[c] * SIDE + y[e], c0=col[c] * SIDE + x[e], k=value[of[e]], node=name(label[e], c))
            going = np.zeros(mask.size, np.int8)
            going[at[opened[label]]] = 1
            m, y0, x0, x1, v = stretches(going.reshape(mask.shape))
            m, y0, x0, x1 = (z[v > 0] for z in (m, y0, x0, x1))
            whole = np.zeros(mask.size, np.int64)
            whole[at] = label
            c = cell[s + m]
            yield _laid(first, image, OPENED, c, r=row[c] * SIDE + y0, c0=col[c] * SIDE + x0, c1=col[c] * SIDE + x1, k=value[s + m], node=name(whole[(m * h + y0) * w + x0], c))
        m, y0, x0, x1, v = stretches(best)
        for kind, those in ((DONE, ~unfinished), (MERGED, unfinished)):
            i = np.flatnonzero((v > 0) & those[m])
            if len(i):
                yield _laid(first, image, kind, m[i], r=row[m[i]] * SIDE + y0[i], c0=col[m[i]] * SIDE + x0[i], c1=col[m[i]] * SIDE + x1[i], k=v[i])

    return run


def _beyond(r: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_on_border`` where the image's end is known."""
    return ((r == 0) & (row > 0)) | ((r == SIDE - 1) & (row * SIDE + r < h - 1)) | ((c == 0) & (col > 0)) | ((c == SIDE - 1) & (col * SIDE + c < w - 1))


def postprocessed(runs: DataFrame, sizes: DataFrame, threshold: float = 0.001, below: int = 10) -> DataFrame:
    """Runs of each foreground class after dilation, with holes of fewer than ``below`` pixels filled and components under ``threshold`` of the image dropped; of several classes the greatest stays.

    An image that ``sizes`` lacks has no rows; a null img is an image like any other.
    """
    kind = runs.schema["img"].dataType.simpleString()
    of = sizes.filter("h IS NOT NULL AND w IS NOT NULL").select(F.col("img").alias("_img"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w")).hint("merge")
    dealt = cells.packed(runs.filter("k > 0"), DISK + below).join(of, F.col("img").eqNullSafe(F.col("_img"))).drop("_img")
    found = stored(cells.met(dealt).mapInArrow(_cleaned(float(threshold), below), f"img {kind}, kind int, r int, c0 int, c1 int, k int, node long, n long, least double"), "cleaned")
    done, border = found.filter(F.col("kind") == DONE).select("img", "r", "c0", "c1", "k"), found.filter(F.col("kind") == BORDER)
    if border.isEmpty():
        return done
    labels = stored(_labels_across(border.select("img", "k", "node", "r", F.col("c0").alias("c"))), "across")
    parts = _labelled(found.filter(F.col("kind") == PARTS).select("img", "k", "node", "n", "least"), labels)
    large = parts.groupBy("img", "k", "label").agg(F.sum("n").alias("n"), F.first("least").alias("least")).filter("n >= least")
    large = large.select(F.col("img").alias("_i"), F.col("k").alias("_c"), F.col("label").alias("_l")).hint("merge")
    opened = _labelled(found.filter(F.col("kind") == OPENED).select("img", "r", "c0", "c1", "k", "node"), labels)
    opened = opened.join(large, F.col("img").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_c")) & (F.col("label") == F.col("_l")))
    rest = merge_max(found.filter(F.col("kind") == MERGED).select("img", "r", "c0", "c1", "k"), opened.select("img", "r", "c0", "c1", "k"))
    return done.unionByName(rest)
