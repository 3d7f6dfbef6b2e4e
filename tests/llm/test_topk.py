import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import topk as K


def brute(rows, k=10, every=100):
    """rank rows of every query over all other rows."""
    dim = max((len(v) for _, v in rows), default=0)
    vecs = [(i, [math.floor(1024 * x) for x in v] + [0] * (dim - len(v))) for i, v in rows]
    out = []
    for n, (q, v) in enumerate(vecs):
        if q % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for m, (i, w) in enumerate(vecs) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(map(tuple, K.exact_top_k(vectors).collect()))
    assert got == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(0, 400, 4)]
    good += [(100, [1.0, 2.0, 0.5, 0.0]), (100, [1.0, 2.0, 0.5, 0.0]), (7, [9.0]), (300, [])] + [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(1, 60)]
    bad = [(900, None), (901, [1.0, None]), (200, [math.nan, 1.0]), (902, [math.inf]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], "vec_id long, embedding array<double>, score int").repartition(3)
    assert sorted(map(tuple, K.exact_top_k(df).collect())) == brute(good)
    assert K.exact_top_k(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, K.exact_top_k(few).collect())) == [(0, 1, 1, 1024 * 2048)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5))
def test_elimination_is_exact(seed, k):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-4, 5, (200, 3)).astype(float), rng.integers(-4, 5, 3).astype(float)
    top = float(max((x * x).sum(1).max(), q @ q))
    pivots = K._pick_pivots(x[:50], 6)
    best = K.Best(k)
    q_dist = np.sqrt(np.maximum((q * q).sum() + top - 2 * pivots @ q, 0))
    for part in (slice(0, 80), slice(80, 200)):
        K.eliminate(q, q_dist, x[part], K._distances(x[part], pivots, top), np.arange(200)[part], top, best, block=4)
    want = sorted((-(x[i] @ q), i) for i in range(200))[:k]
    assert list(zip((-best.score).tolist(), best.ids.tolist(), strict=True)) == want


def test_huge_components(spark):
    rng = np.random.default_rng(9)
    for scale in (3e6, 1e12, 1e300):
        rows = [(i, (rng.normal(size=3) * (scale if i % 3 else 1)).tolist()) for i in range(60)] + [(100, [scale, -scale, 1.5]), (101, [scale, -scale, 0.5]), (102, [scale, -scale, 1.5])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, K.exact_top_k(df).collect())) == brute(rows)
