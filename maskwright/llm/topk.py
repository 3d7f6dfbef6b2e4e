"""Exact top-k by inner product with pivot-table elimination.

Vectors are integers ``floor(1024 x)``. With one more coordinate
``sqrt(M^2 - |x|^2)`` (M the longest norm; 0 for a query), the Euclidean distance
orders candidates as the inner product does. The distances of every candidate to
many pivots are computed once and stored; for a query, the largest
``|d(x, p) - d(q, p)|`` over the pivots is a lower bound of the distance and so
gives an upper bound of the inner product. Candidates are evaluated in the order
of their bounds until the next bound cannot reach the k-th best score: exact.

Scores are exact integers: in float64 where every product sum stays below 2^53, by
Python's integers beyond (``EXACT``); a score beyond 64 bits is set to the nearest
64-bit integer. Bounds are then taken of vectors divided by a power of two.

Queries go in blocks of at most ``QUERY_BLOCK`` (the only thing that is sent to
all executors: at most 8,192 vectors), each against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Squared norms below this are exact in float64, and so are all scores.
EXACT = float(1 << 52)
QUERY_BLOCK = 8192
PIVOTS = 24
#: Pivots are picked among this many rows, least by a hash; every row is indexed.
PIVOT_SAMPLE = 2048


def _pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal over a bounded sample."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Augmented distances of rows to pivots; pivots and rows both carry the extra coordinate."""
    extra_x = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    extra_p = np.sqrt(np.maximum(top - (pivots * pivots).sum(1), 0))
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T + (extra_x[:, None] - extra_p[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as float64, shorter vectors padded with zeros."""
    out = np.zeros((len(column), dim))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _index(pivots: np.ndarray, dim: int, top: float, unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            d = _distances(x / unit, pivots, top)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array([r.tobytes() for r in d.astype("<f8")], pa.binary())], names=["vec_id", "vec", "dist"]
            )

    return run


def exact_scores(x: np.ndarray, q: np.ndarray, unit: float) -> np.ndarray:
    """Inner products of integer-valued rows with ``q``, as 64-bit integers."""
    if unit == 1:
        return (x @ q).astype(np.int64)
    ints = [int(v) for v in q]
    whole = [sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in x.tolist()]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


class Best:
    """The k best (score, id) of one query so far: higher scores first, ties to the smaller id."""

    __slots__ = ("k", "score", "ids")

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, ~s))[: self.k]
        self.score, self.ids = s[order], i[order]


def eliminate(q: np.ndarray, q_dist: np.ndarray, x: np.ndarray, dist: np.ndarray, ids: np.ndarray, top: float, best: Best, block: int = 64, unit: float = 1) -> int:
    """Adds to ``best`` what a batch has; returns how many candidates were evaluated. ``top`` and distances are those of vectors divided by ``unit``."""
    lower = np.zeros(len(x))
    for p in range(dist.shape[1]):
        np.maximum(lower, np.abs(dist[:, p] - q_dist[p]), out=lower)
    both = float((q / unit) @ (q / unit)) + top
    upper = (both - lower * lower) / 2 + 1e-9 * (both + 1) + 1e-3  # more than rounding can lose
    live = np.flatnonzero(upper >= best.floor / unit / unit)
    order, done = live[np.argsort(-upper[live], kind="stable")], 0
    while done < len(order) and upper[order[done]] >= best.floor / unit / unit:
        part = order[done : done + block]
        best.add(exact_scores(x[part], q, unit), ids[part])
        done, block = done + len(part), block * 2
    return done


def _search(uids: list[int], queries: np.ndarray, pivots: np.ndarray, dim: int, top: float, k: int, unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a query's extra coordinate is 0
        small = queries / unit
        square = (small**2).sum(1)[:, None] + top - 2 * small @ pivots.T
        q_dist, best = np.sqrt(np.maximum(square, 0)), [Best(k) for _ in uids]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(len(ids), dim)
            dist = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(len(ids), len(pivots))
            for j in range(len(uids)):
                eliminate(queries[j], q_dist[j], x, dist, ids, top, best[j], unit=unit)
        for j, b in enumerate(best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), uids[j]), pa.int64()), pa.array(b.ids, pa.int64()), pa.array(b.score)], names=["uid", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k`` best other rows.

    A vector that is null or holds a null, NaN or infinity (also one that the scale
    makes infinite), and a row without vec_id, takes no part. Vectors of unlike lengths
    count as padded with zeros. A repeated row is a candidate for its twin: just one own
    row is left out. Equal scores go to the smaller vec_id. An empty table, or one
    without queries, gives no rows; further columns play no part.
    """
    spark = vectors.sparkSession
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # from 2^53 on, a double is whole as it is; floor() would leave the range of long
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    # an infinity minus itself is NaN, which equals nothing but itself
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(scaled(x) - scaled(x)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))
    most = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    facts = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(most).alias("most"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).first()
    dim, n_queries = facts["dim"] or 0, facts["queries"] or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries:
        return empty
    # squares of what is left after division can neither overflow nor, for a unit of 1, lose a digit
    unit = 1.0 if (facts["most"] or 0) < math.sqrt(EXACT / max(dim, 1)) else 2.0 ** (math.frexp(facts["most"])[1] - 20)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit))
    top = rows.agg(F.max(norm)).first()[0] * (1 + 1e-12)
    pad = lambda found: np.array([list(r["vec"]) + [0.0] * (dim - len(r["vec"])) for r in found], float).reshape(len(found), dim)
    pivots = _pick_pivots(pad(rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(PIVOT_SAMPLE).collect()) / unit, PIVOTS)
    index = stored(rows.mapInArrow(_index(pivots, dim, top, unit), "vec_id long, vec binary, dist binary"), "pivots")
    blocks, out = -(-n_queries // (QUERY_BLOCK // 2)), None
    asked = rows.filter(F.col("vec_id") % every == 0)
    for b in range(blocks):
        # half-full blocks on average: a hash deals them, so none comes near QUERY_BLOCK but by repeated rows
        part = asked.filter(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()
        for start in range(0, len(part), QUERY_BLOCK):
            piece = part[start : start + QUERY_BLOCK]
            q = pad(piece)
            found = index.mapInArrow(_search(list(range(len(piece))), q, pivots, dim, top, k + 1, unit), "uid long, vec_id long, score long")
            who = spark.createDataFrame([(i, r["vec_id"], int(exact_scores(v[None], v, unit)[0])) for i, (r, v) in enumerate(zip(piece, q, strict=True))], "uid long, query_id long, own long")
            found = found.join(F.broadcast(who), "uid")
            own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
            order = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
            found = found.withColumn("_own", F.sum(own.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).filter(~(own & (F.col("_own") == 1)))
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            found = stored(found, "topk") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    return out if out is not None else empty
