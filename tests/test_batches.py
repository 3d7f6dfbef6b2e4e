import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import batches, dense, prompted, rows
from maskwright.sources import shapefile as S
from maskwright.sources import shared


def test_positions_within_groups_of_any_size(spark):
    draw = random.Random(1)
    data = [(draw.choice([1, 1, 1, 2, None, 3]), draw.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g long, t long, id long")
    got = batches.numbered(df, ["t", "id"], "g")
    assert got.columns == ["g", "t", "id", "position"]
    want = {}
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r: i for i, r in enumerate(mine)}
    assert {(r.g, r.t, r.id): r.position for r in got.collect()} == want
    whole = batches.numbered(df, ["t", "id"])
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert [(r.g, r.t, r.id) for r in sorted(whole.collect(), key=lambda r: r.position)] == order
    assert batches.numbered(df.limit(0), ["t"], "g").count() == 0


def test_no_task_sees_all_rows(spark):
    plan = batches.numbered(spark.range(1000).withColumn("g", F.lit(1)), ["id"], "g")
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_text_batches(spark):
    data = [(3, [7, 8, 9]), (1, [5]), (2, None), (4, []), (5, [1, 2])]
    df = spark.createDataFrame(data, "id long, ids array<int>")
    got = sorted((r.batch, r.place, r.id, r.input_ids, r.attention_mask, r.labels) for r in batches.text_batches(df, ["id"], "ids", 3, pad=0, end=2, label_pad=-100).collect())
    assert got == [
        (0, 0, 1, [5, 2, 0, 0], [1, 1, 0, 0], [5, 2, -100, -100]),
        (0, 1, 2, [2, 0, 0, 0], [1, 0, 0, 0], [2, -100, -100, -100]),
        (0, 2, 3, [7, 8, 9, 2], [1, 1, 1, 1], [7, 8, 9, 2]),
        (1, 0, 4, [2, 0, 0], [1, 0, 0], [2, -100, -100]),
        (1, 1, 5, [1, 2, 2], [1, 1, 1], [1, 2, 2]),
    ]
    plain = batches.text_batches(df, ["id"], "ids", 3)
    assert all(r.labels == r.input_ids for r in plain.collect())
    assert "labels" not in batches.text_batches(df, ["id"], "ids", 3, need_labels=False).columns


def test_batches_are_stacked_in_order(spark):
    df = spark.createDataFrame([(i, i * 10, [i, 1]) for i in (5, 3, 9, 1, 7)], "id long, image long, mask array<int>")
    got = sorted(batches.segmentation_batches(df, ["id"], 2).collect())
    assert [(r.batch, r.n, r.pixel_values, r.labels) for r in got] == [(0, 2, [10, 30], [[1, 1], [3, 1]]), (1, 2, [50, 70], [[5, 1], [7, 1]]), (2, 1, [90], [[9, 1]])]


def test_prompted_masks(spark):
    rng = np.random.default_rng(3)
    label2id = {"a": 4, "b": 7, "c": 0}
    data = []
    for img in range(30):
        n, lh, lw, h, w = (int(rng.integers(1, 5)) for _ in range(5))
        data.append((img, [str(x) for x in rng.choice(["a", "b", "c"], n)], rng.integers(-3, 4, n * lh * lw).astype(float).tolist(), lh, lw, h, w))
    df = spark.createDataFrame(data, "img long, texts array<string>, logits array<double>, lh int, lw int, h int, w int")

    def value(m, y, x):
        lh, lw = m.shape
        y0, x0 = int(y), int(x)
        y1, x1 = min(y0 + 1, lh - 1), min(x0 + 1, lw - 1)
        return (m[y0, x0] * (1 - x + x0) + m[y0, x1] * (x - x0)) * (1 - y + y0) + (m[y1, x0] * (1 - x + x0) + m[y1, x1] * (x - x0)) * (y - y0)

    want = {}
    for img, texts, logits, lh, lw, h, w in data:
        maps, out = np.array(logits).reshape(len(texts), lh, lw), []
        for r in range(h):
            for c in range(w):
                y, x = (min(max((i + 0.5) * a / b - 0.5, 0), a - 1) for i, a, b in ((r, lh, h), (c, lw, w)))
                scores = [round(value(m, y, x), 9) for m in maps]
                out.append({label2id[t] for t, s in zip(texts, scores, strict=True) if s == max(scores)} if scores.count(max(scores)) > 1 else {label2id[texts[int(np.argmax(scores))]]})
        want[img] = out
    got = {r.img: r.mask for r in prompted.prompted_masks(df, label2id).collect()}
    assert got.keys() == want.keys() and all(len(got[i]) == len(want[i]) and all(k in ks for k, ks in zip(got[i], want[i], strict=True)) for i in got)
    one = spark.createDataFrame([(1, ["b", "a"], [1.0, 1.0], 1, 1, 1, 1)], df.schema)
    assert prompted.prompted_masks(one, label2id).first().mask == [7]
    for bad in ([(1, ["x"], [1.0], 1, 1, 1, 1)], [(1, ["a"], [1.0, 2.0], 1, 1, 1, 1)], [(1, [], [], 1, 1, 1, 1)]):
        with pytest.raises(Exception, match="unknown text|logits must"):
            prompted.prompted_masks(spark.createDataFrame(bad, df.schema), label2id).collect()
    assert prompted.prompted_masks(df.limit(0), label2id).count() == 0


def test_shapefiles_there_and_back(spark):
    folder = shared.new_folder(spark, "shapes")
    data = [(i, None if i % 5 == 0 else i * 3, [0.0, 0.0, 4.0 + i, 0.5, 3.0, 5.0]) for i in range(200)] + [(500, 1, [0.0, 0.0, 3.0, 5.0, 4.0, 0.5])]
    df = spark.createDataFrame(data, "id long, much_longer_name long, points array<double>").repartition(3)
    spark.dataSource.register(S.ShapefileSource)
    df.write.format("shapefile").option("fileBytes", 3000).mode("append").save(folder)
    back = {r.id: (r.much_longer_name, r.points) for r in S.read_shapefiles(spark, folder, ["id", "much_longer_name"]).collect()}
    assert len(back) == 201 and back[500] == (1, [0.0, 0.0, 3.0, 5.0, 4.0, 0.5])
    for i, n, p in data[:200]:  # those turn clockwise
        assert back[i] == (n, [p[4], p[5], p[2], p[3], p[0], p[1]])
    store, at = S.file_system(folder)
    names = [f.base_name for f in store.get_file_info(S.pyarrow.fs.FileSelector(at))]
    assert "_SUCCESS" in names and sum(n.endswith(".shp") for n in names) > 3 and not any("part" in f.base_name for f in store.get_file_info(S.pyarrow.fs.FileSelector(f"{at}/_temporary")))
    shp = [n for n in names if n.endswith(".shp")][0]
    data, index = (store.open_input_stream(f"{at}/{shp[:-3]}{k}").readall() for k in ("shp", "shx"))
    assert S.struct.unpack(">i", data[24:28])[0] * 2 == len(data) and S.struct.unpack(">i", index[24:28])[0] * 2 == len(index)
    for k in range((len(index) - 100) // 8):  # the index finds every record
        offset, words = S.struct.unpack(">2i", index[100 + 8 * k : 108 + 8 * k])
        assert S.struct.unpack(">2i", data[offset * 2 : offset * 2 + 8]) == (k + 1, words)


def test_a_failed_shapefile_write_leaves_nothing(spark):
    folder = shared.new_folder(spark, "shapes")
    df = spark.createDataFrame([(i, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0] if i else [0.0, 0.0]) for i in range(20)], "id long, points array<double>").repartition(2)
    with pytest.raises(Exception, match="three points"):
        S.write_shapefiles(df, folder)
    store, at = S.file_system(folder)
    assert not [f for f in store.get_file_info(S.pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.is_file]


def test_a_long_series_streams(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") < 3, -1e9).otherwise(F.col("id") * 1.0).alias("loss"))
    start = time.time()
    got = {r.g: (r.best, r.counter, r.stopped) for r in rows.early_stopping(df, "g", ["id"], "loss").collect()}
    assert got == {g: (1e9, 99_999, True) for g in range(3)} and time.time() - start < 60
    edges = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (1, 1, None), (1, 2, 5.0)], "g long, t long, loss double")
    assert {(r.g, r.best, r.counter, r.stopped) for r in rows.early_stopping(edges, "g", ["t"], "loss").collect()} == {(None, -2.0, 1, False), (1, -5.0, 0, False)}


def test_only_the_name_background_is_left_out(spark):
    results = spark.createDataFrame([(1, x, 3, 3, [0, 0, 0, 0, 1, 0, 0, 0, 0]) for x in ("背景", "background", "云", "other")], "img long, label string, h int, w int, mask array<short>")
    got = dense.result_polygons(results, {"背景": 0, "云": 1, "background": 5}, 0.0).collect()
    assert {r.category_id for r in got} <= {-1, 0}
