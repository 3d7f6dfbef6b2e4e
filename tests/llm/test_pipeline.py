import corpus_pipeline as P
from test_decontaminate import D
from test_packing import check


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [" ".join(D.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept.keys() <= texts.keys()
        if name == "language_id":
            assert len(kept) >= 0.98 * len(texts)
        if name == "near_dedup":
            assert len(set(kept.values())) == len(kept)
        if name == "decontamination":
            assert {i for i, t in texts.items() if any(x in " ".join(D.words(t)) for x in items)} == texts.keys() - kept.keys()
        elif name != "substring_dedup":
            assert all(kept[i] == texts[i] for i in kept)
        docs, texts = out, kept
    check(P.STAGES[-1][1](spark, docs, sf).collect(), texts, 2048)


def test_empty(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_nulls_repeats_and_odd_columns_through_all_stages(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += rows[:10] + [(None, rows[0][1], None, None, None), (1000, None, "en", None, None), (1001, "", None, "s", 0), (None, None, None, None, None), (1002, rows[3][1] * 40, "en", "s", 9)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row int, key binary, class_id long, request boolean, gone string"
    df = spark.createDataFrame([(*r, "dot", 7, b"k", 3, True, "g") for r in rows], shape)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and out.schema["a.b"].dataType == docs.schema["a.b"].dataType
        assert {r["a.b"] for r in out.collect()} == {"dot"} and {r["row"] for r in out.collect()} == {7}
        docs = out
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept) == len({t for _, t in kept}) and len(kept) > 30
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and {p.doc_id for p in pieces} == {i for i, _ in kept}
