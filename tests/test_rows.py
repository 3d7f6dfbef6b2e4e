import os
"""Edge cases of the row operators, captions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions.labels import VOCABULARIES, label_dim
from maskwright.operators import captions, dense, maskstats, raster, rows
from maskwright.sources import tables
from maskwright.streaming.early_stopping import early_stopping_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths(spark):
    up = lambda p: one(spark, rows.rebase_path(F.lit(p), "/d/s/t.parquet"))
    assert [up(p) for p in (".\\a\\b", "./a", "../a", "c\\d")] == ["/d/s//a/b", "/d/s//a", "/d/s/./a", "c/d"]
    with pytest.raises(ValueError):
        rows.unbase_path(F.lit("x"), "t.parquet")


def test_labels(spark):
    hot = lambda ids, **k: one(spark, rows.multi_hot(F.array(*map(F.lit, ids)), 4, **k))
    assert hot([0, 1, 4, -2]) == [1, 0, 0, 1] and hot([0, 3], reduce_labels=False) == [1, 0, 0, 1]
    for bad in ({"ids": [5]}, {"ids": [-1], "reduce_labels": False}):
        with pytest.raises(Exception, match="out of range"):
            hot(**bad)
    with pytest.raises(Exception, match="unknown key"):
        maskstats.strict_lookup(spark.createDataFrame([(99,)], "label_id int"), label_dim(spark, "qa"), "label_id").collect()
    assert label_dim(spark).filter("label_name = '云' AND vocab = 'qa'").first().family == "area"


def test_rounding_types(spark):
    df = spark.createDataFrame([(1.1234567, [1.0000049], "x")], "a double, b array<double>, c string")
    assert rows.round_values(df, ["a", "b"]).first()[:2] == (1.12346, [1.0])
    with pytest.raises(TypeError):
        rows.round_values(df, ["c"])


def test_pairs_and_zip(spark):
    assert one(spark, rows.pair_up(F.array(*map(F.lit, [1, 2, 3, 4, 5])))) == [(1, 2), (3, 4)]
    assert one(spark, rows.pair_up(F.array().cast("array<int>"))) == []
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"])], "id int, x array<int>, y array<string>")
    assert [(r.pos, r.x, r.y) for r in rows.zip_shortest(df, "x", "y").collect()] == [(0, 1, "a"), (1, 2, "b")]


def test_nulls_and_sentinels(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k int, v string")
    assert [r.k for r in rows.drop_null_rows(df).collect()] == [1]
    assert one(spark, rows.replace_sentinel(F.array(F.lit(-100), F.lit(7)), 0)) == [0, 7]


def test_checkpoints(spark, tmp_path):
    for k, (name, size) in enumerate([("run1/z.pt", 3), ("run2/a.pt", 5), ("run2/b.pth", 2), ("run2/d.PTH", 9), ("run2/e.txt", 1), ("other/x.pt", 7)]):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
        os.utime(path, (1000 + k, 1000 + k))
    files = tables.checkpoints(spark, str(tmp_path))
    root = files.filter("path LIKE '%run1%'").first().path.split("run1")[0]
    got = rows.newest(files, root + "run").first()
    assert got.path.endswith("run2/b.pth") and got.length == 2
    assert rows.newest(files, root + "none").collect() == []
    with pytest.raises(Exception, match="empty checkpoint"):
        rows.newest(spark.createDataFrame([("run/x.pt", 1, 0)], "path string, modified int, length int"), "run").collect()


def test_noise_differs_by_row(spark):
    df = spark.createDataFrame([(i, [0.0] * 400) for i in range(20)], "id long, x array<double>")
    got = [r.y for r in df.select(rows.gaussian_noise(F.col("x"), F.col("id"), 1).alias("y")).collect()]
    assert len({tuple(y) for y in got}) == 20
    flat = [v for y in got for v in y]
    mean = sum(flat) / len(flat)
    assert abs(mean) < 0.05 and abs(sum(v * v for v in flat) / len(flat) - 1) < 0.05
    again = [r.y for r in df.select(rows.gaussian_noise(F.col("x"), F.col("id"), 1).alias("y")).collect()]
    assert again == got


def test_model_configuration(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {str(i): n for i, n in VOCABULARIES["classifier"].items()}}, ensure_ascii=False))
    assert {r.label_id: r.label_name for r in tables.model_labels(spark, str(tmp_path / "config.json")).collect()} == VOCABULARIES["classifier"]


def test_captions(spark):
    ids = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.31), (1, 1, 0.3), (1, 3, 0.001), (2, 0, 1.0)], "img int, k int, area double")
    names = VOCABULARIES["qa"]
    assert {r.img: r.caption for r in captions.id_captions(ids, names).collect()} == {1: "卫星图像有小面积的云，大面积的阴影。", 2: "卫星图像完全合格。"}
    assert captions.id_captions(ids, names, "en", with_area=False).filter("img = 1").first().caption == "A satellite image has 云 and 阴影 and 拉花"
    found = captions.caption_ids(spark.createDataFrame([("有云和阴影",), ("完全合格云",)], "caption string"), {n: i for i, n in names.items()}).collect()
    assert [r.category_ids for r in found] == [[1, 2], []]
    assert one(spark, captions.region_title(F.lit(3))) == "这张卫星影像存在拼接错误，分界线在上边，是一条横线。"


def test_answers(spark):
    rows_ = [(1, 1, 0.5, 2, 4, 4, 3, 3), (1, 2, 0.005, 2, 0, 0, 3, 3), (1, 4, 0.1, 2, 0, 2, 5, 3), (1, 9, 0.1, 3, 8, 2, 5, 3), (1, 3, 0.0, 1, 0, None, 0, 0), (2, 1, 0.0, 1, 0, None, 0, 0)]
    df = spark.createDataFrame(rows_, "img int, k int, area double, num int, area_cell int, centre_cell int, w int, h int")
    got = {(r.img, r.pos): r.answer for r in captions.attribute_answers(df, VOCABULARIES["qa"]).collect()}
    assert got[1, 0] == "是，这张卫星图像有质量问题，问题类型有：云、阴影、拼接痕迹、条状噪声。" and got[2, 0] == "否，这张卫星图像没有质量问题。"
    assert got[1, 1] == "是，这张卫星图像几乎全是云。" and got[1, 2] == "是，这张卫星图像中可能存在多处微小的阴影，主要位于图像的左上角"
    assert got[1, 3] == "否，这张卫星图像中不存在拉花。" and got[1, 4] == "是，这张卫星图像中存在一条拼接痕迹的痕迹，位于图像的右上角，大致是横向的。"
    assert got[1, 5] == "是，这张卫星图像中存在3处条状噪声，主要位于图像的右下角。"


def test_masks(spark):
    px = spark.createDataFrame([(1, r, c, 1 if c >= 7 else 0) for r in range(4) for c in range(8)], "img int, r int, c int, k int")
    back = dense.to_pixels(dense.to_dense(px, 4, 8))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    assert maskstats.area_ratio(px).agg(F.sum("area").alias("s")).first().s == 1.0
    assert dense.centre_cell(dense.to_dense(px, 4, 8), 4, 8, strict=False).first().cell == 1 * 3 + 7 // 2  # the remainder's column counts as a fourth
    flipped = rows.flip(rows.flip(px, 4, 8, F.lit(True), F.lit(True)), 4, 8, F.lit(True), F.lit(True))
    assert sorted(map(tuple, flipped.select("img", "r", "c", "k").collect())) == sorted(map(tuple, px.collect()))
    with pytest.raises(ValueError):
        maskstats.nine_cell(px, 2, 8)


def test_polygons(spark):
    square = [1, 1, 4, 1, 4, 4, 1, 4]
    df = spark.createDataFrame([(1, [square, square], [2, 2]), (2, [square], [0])], "img int, points array<array<int>>, category_id array<int>")
    k = {(r.img, r.r, r.c): r.k for r in raster.semantic_mask(df, 8, 8).collect()}
    assert (1, 2, 2) not in k and k[1, 1, 1] == 2 and not any(i == 2 for i, _, _ in k)
    assert raster.semantic_mask(df, 8, 8, background_as_class0=False).filter("img = 2").count() == 16
    assert {r.inst for r in raster.instance_mask(df, 8, 8).filter("img = 1").collect()} == {2}
    with pytest.raises(Exception, match="no polygons"):
        raster.instance_mask(spark.createDataFrame([(1, [], [])], df.schema), 8, 8).collect()


def test_augment(spark):
    df = spark.createDataFrame([(1, "a b  c", 0), (2, None, 0), (3, "x", 1)], "id int, t string, label int")
    out = {r.id: r.t for r in rows.augment(df, "t", "id").collect()}
    assert out.keys() == {1, 3} and out != {1: "a b  c", 3: "x"}
    assert [w for w in out[1].split(" ") if w not in ".,!?;:" or not w] == ["a", "b", "", "c"]
    assert rows.augment(df, "t", "id", ratio=0).count() == 3


def test_early_stopping(spark, tmp_path):
    losses = [(1, i, x) for i, x in enumerate([5.0, 4.0, 6.0, 6.0, 3.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(losses, "g int, ord int, loss double")
    want = rows.early_stopping(df, "g", ["ord"], "loss", patience=3).first()
    assert (want.best, want.counter, want.stopped) == (-3.0, 3, True)
    for part in (0, 1):
        df.filter(f"ord DIV 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = early_stopping_stream(stream, "g", "ord", "loss", patience=3).writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.sql("SELECT * FROM stops").collect()[-1]
    assert (last.best, last.counter, last.stopped) == (-3.0, 3, True)


def test_exact_share_goes(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(1).alias("y")).unionByName(spark.range(5).select("id", F.lit(0).alias("y")))
    for share, left in ((0.0, 705), (0.9, 71), (1.0, 0)):  # 705 x 0.9 = 634.5, to even
        got = rows.drop_share(df, "y", "id", share)
        counts = dict(got.groupBy("y").count().collect())
        assert got.columns == df.columns and counts.get(0, 0) == left and counts[None] == 100 and counts[1] == 200
    assert rows.drop_share(df.filter("y = 1"), "y", "id").count() == 200 and rows.drop_share(df.limit(0), "y", "id").count() == 0
