import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import decontaminate as D


def brute_scores(index, terms):
    out = {}
    for t in terms:
        for d, x in zip(index.docs[t], index.impacts[t], strict=True):
            out[d] = out.get(d, 0) + x
    return out


WORDS = st.lists(st.sampled_from("the of alpha beta gamma delta eps zeta eta theta iota kappa".split()), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=80), WORDS, st.sampled_from([0.2, 0.5, 0.9]))
def test_wand_finds_all(items, query, threshold):
    index = D.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    terms = sorted({index.term[w] for w in query if w in index.term})
    want = {d: s for d, s in brute_scores(index, terms).items() if s >= threshold - 1e-9}
    got = dict(index.search(terms, threshold))
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


@settings(max_examples=80, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=40), st.lists(st.sampled_from("the of alpha beta gamma delta other words".split()), max_size=300))
def test_bound_loses_nothing(items, doc):
    index = D.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    ids = np.array([index.term.get(w, -1) for w in doc], np.int64)
    maybe = set(index.possible(ids, 0.5).tolist())
    for p in range(-(-len(doc) // D.STRIDE)):
        here = ids[p * D.STRIDE : (p + 2) * D.STRIDE]
        if any(s >= 0.5 for s in brute_scores(index, sorted(set(here[here >= 0].tolist()))).values()):
            assert p in maybe


def test_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = bench.collect()
    want = {(r.doc_id, b.item_id) for r in docs.collect() for b in items if " ".join(D.words(b.text)) in " ".join(D.words(r.text))}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert want and got == want
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(300)) + ". " + " ".join(f"a{i}" for i in range(20))
    bench = spark.createDataFrame([(1, "What is the tallest peak of the grey range? It is mount Example near the lake."), (2, None), (3, ""), (4, long)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "pre " * 200 + "what is the tallest peak of the grey range it is mount example near the lake" + " post" * 100, 1), (2, None, 1), (3, "", 1), (4, "x " + long, 1), (5, "What is the tallest peak of the grey range? Nobody knows at all here.", 1), (6, "filler " * 60000, 1)],
        "doc_id long, text string, item_id int",
    )
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == {(1, 1), (4, 4)}
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} == {2, 3, 5, 6}
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.decontaminate(docs, bench.limit(0)).count() == 6
    assert D.contaminated(docs.limit(0), bench).collect() == []


def test_blocks_change_nothing(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    blocks = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in blocks] and np.allclose([x[2:] for x in whole], [x[2:] for x in blocks])


def test_one_changed_word(spark):
    items = ["Which river crosses the old town of Karam before it meets the sea? The slow Anver does so.", "the quick brown fox of the far hills jumped over nine lazy dogs while seven grey cats looked on from barns near by", "Name the largest moon. It is Teth."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id short, text string")
    rows = []
    for i, item in enumerate(items[:2]):
        w = D.words(item)
        rows += [(100 * i + k, "before it " * 30 + " ".join([*w[:k], "changed", *w[k + 1 :]]) + " and after" * 20) for k in range(len(w))]
    rows += [(900, "something else about a river and the old town " * 20), (900, items[2]), (900, items[2])]
    got = sorted((r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == sorted([(d, d // 100) for d, _ in rows[:-3]] + [(900, 2)] * 2)


def test_columns_of_any_name(spark):
    item = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, item, 1, "a"), (2, "clean text", 2, "b"), (3, None, 3, "c")], "doc_id long, text string, `x.y` int, `row` string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.decontaminate(df, bench)
    assert out.columns == df.columns and sorted((r.doc_id, r["x.y"], r["row"]) for r in out.collect()) == [(2, 2, "b"), (3, 3, "c")]
