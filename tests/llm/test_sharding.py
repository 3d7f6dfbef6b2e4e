import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from maskwright.llm import sharding as S


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, texts = S.shard_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    by = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_growth_and_weights(spark):
    keys = spark.range(6000)
    at = lambda w, **k: {r.id: r.shard for r in S.assign(keys, "id", w, **k).collect()}
    for n in (5, 8, 13):
        old, new = at([1.0] * n), at([1.0] * (n + 1))
        moved = [i for i in old if old[i] != new[i]]
        assert all(new[i] == n for i in moved) and 0.6 * 6000 / (n + 1) < len(moved) < 1.5 * 6000 / (n + 1)
    before, after = at([1.0, 1.0, 1.0, 1.0, 1.0]), at([1.0, 1.0, 3.0, 1.0, 1.0])
    assert all(after[i] == 2 for i in before if before[i] != after[i])
    n = Counter(after.values())
    assert 0.85 * 6000 * 3 / 7 < n[2] < 1.15 * 6000 * 3 / 7
    assert 0 not in at([0.0, 1.0]).values()


def test_descent_is_the_least_leaf(spark):
    d = S.draws(F.col("id"), [1.0] * 11)
    rows = spark.range(300).select(d.alias("d"), S.descend(d, S.topology(11)).alias("s")).collect()
    assert all(r.s == r.d.index(min(r.d)) for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "é" * 100000, 9), (3, "é" * 100000, 9), (None, "x", 9)], "doc_id long, text string, shard int")
    rows = sorted(S.shard_documents(df).collect(), key=lambda r: (r.doc_id or 0, r["size"], r.slot))
    assert [r["size"] for r in rows] == [17, 16, 16, 200016, 200016] and rows[1].text_crc32 == 0
    assert rows[3].shard == rows[4].shard and rows[3].slot != rows[4].slot
    assert S.shard_documents(df.limit(0)).collect() == []
