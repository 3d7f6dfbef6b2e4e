"""The registered queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.labels import AREA_WORDS, CAPTION, CELLS, FAMILIES, LINES, MARKS, NO_CELL, QA, REGIONS, TITLE, VOCABULARIES, label_dim
from ..operators import batches, captions, decoding, dense, maskstats, prompted, raster, rows, run_shapes, runs, tiles
from ..sources.shapefile import read_shapefiles, write_shapefiles
from ..sources.shared import new_folder, qualified
from ..sources.tables import HEIGHT, WIDTH, checkpoints, dealt, images, masks, model_labels, pixels, polygons, table
from . import transforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NAMES = VOCABULARIES["qa"]
LABEL2ID = {n: i for i, n in NAMES.items()}
H3, W3 = HEIGHT // 3, WIDTH // 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in xs) + "]"


PX = """px AS (
  SELECT img, r, c, CASE WHEN v < 11 THEN v ELSE 0 END AS k
  FROM (SELECT p_partkey AS img, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c,
               CAST(((r // 4) * 3 + (c // 5) * 5 + p_partkey * 7 + p_size) % 17 AS INTEGER) AS v
        FROM part, unnest(range(0, 20)) a(r), unnest(range(0, 23)) b(c)))"""
DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(n)})" for i, n in NAMES.items()) + ") t(label_id, label_name))"
AREA = "ar AS (SELECT img, k, n, n / sum(n) OVER (PARTITION BY img) AS area FROM (SELECT img, k, count(*) AS n FROM px GROUP BY img, k))"
ALL = "al AS (SELECT i.img, d.label_id AS k, coalesce(a.n, 0) AS n, coalesce(a.area, 0) AS area FROM (SELECT DISTINCT img FROM px) i CROSS JOIN dim d LEFT JOIN ar a ON a.img = i.img AND a.k = d.label_id WHERE d.label_id <> 0)"
BOX = "bx AS (SELECT img, k, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM px WHERE k <> 0 GROUP BY img, k)"
_CELLS = ", ".join(f"count(*) FILTER (WHERE r // {H3} = {i // 3} AND c // {W3} = {i % 3})" for i in range(9))
CELL = f"ce AS (SELECT img, k, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS cell, l FROM (SELECT img, k, [{_CELLS}] AS l FROM px WHERE k <> 0 GROUP BY img, k))"
_SIX = ["c < 7", "c >= 14", "c >= 7 AND c < 14", "r < 6", "r >= 12", "r >= 6 AND r < 12"]
REGION = "re AS (SELECT img, k, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS region FROM (SELECT img, k, [" + ", ".join(f"count(*) FILTER (WHERE {x})" for x in _SIX) + "] AS l FROM px WHERE k <> 0 GROUP BY img, k))"
#: A component is spread from those of its pixels that have no equal neighbour before them; the least of these names it.
COMP = """fg AS (SELECT * FROM px WHERE k > 0),
near AS (SELECT a.img, a.k, a.r, a.c, b.r AS r2, b.c AS c2 FROM fg a JOIN fg b ON a.img = b.img AND a.k = b.k AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r, a.c) <> (b.r, b.c)),
seed AS (SELECT img, k, r * 23 + c AS s, r, c FROM fg f WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.img = f.img AND n.r = f.r AND n.c = f.c AND (n.r2 < n.r OR (n.r2 = n.r AND n.c2 < n.c)))),
spread AS (SELECT * FROM seed UNION SELECT n.img, n.k, p.s, n.r2, n.c2 FROM spread p JOIN near n ON n.img = p.img AND n.r = p.r AND n.c = p.c),
lab AS (SELECT img, k, r, c, min(s) AS s FROM spread GROUP BY img, k, r, c),
co AS (SELECT img, k, s, count(*) AS n, sum(r) AS sum_r, sum(c) AS sum_c FROM lab GROUP BY img, k, s)"""
CENTRE = "cx AS (SELECT img, k, CAST(trunc(arg_min(sum_c / n, s)) AS INTEGER) AS x, CAST(trunc(arg_min(sum_r / n, s)) AS INTEGER) AS y FROM co GROUP BY img, k)"


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n"


def _runs(spark, d):
    """The masks as runs of equal pixels."""
    return runs.runs_of(masks(spark, d))


@query(with_(PX, AREA) + "SELECT img, k, n, area FROM ar")
def a1_area_ratio(spark, d):
    return maskstats.area_ratio(_runs(spark, d))


@query(with_(PX, DIM, AREA, ALL) + "SELECT img, k, n, area FROM al")
def a2_area_all_classes(spark, d):
    return maskstats.area_all(_runs(spark, d), list(NAMES))


@query(with_(PX, COMP, recursive=True) + "SELECT img, k, count(*) + 1 AS num FROM co GROUP BY img, k")
def a3_component_count(spark, d):
    return dense.component_counts(masks(spark, d))


@query(with_(PX, BOX) + "SELECT img, k, x, y, w, h FROM bx")
def a4_bounding_box(spark, d):
    return maskstats.bounding_box(_runs(spark, d))


@query(with_(PX, COMP, CENTRE, recursive=True) + "SELECT img, k, x, y FROM cx")
def a5_first_centroid(spark, d):
    return dense.first_centroids(masks(spark, d))


@query(with_(PX, CELL) + f"SELECT img, k, cell, {sql_list(CELLS)}[cell + 1] AS cell_name FROM ce")
def a6_nine_cell(spark, d):
    return maskstats.nine_cell(_runs(spark, d), HEIGHT, WIDTH).withColumn("cell_name", maskstats.cell_name(F.col("cell")))


@query(with_(PX, CELL) + "SELECT img, k, cell, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS cell2 FROM (SELECT *, list_transform(l, lambda x, i: CASE WHEN i = cell + 1 THEN 0 ELSE x END) AS m FROM ce)")
def a6_nine_cell_two(spark, d):
    return maskstats.nine_cell(_runs(spark, d), HEIGHT, WIDTH, 2)


_CENTRE_CELL = f"CASE WHEN y // {H3} * 3 + x // {W3} <= 8 THEN y // {H3} * 3 + x // {W3} END"


@query(with_(PX, COMP, CENTRE, recursive=True) + f"SELECT img, k, {_CENTRE_CELL} AS cell, {sql_list(CELLS)}[{_CENTRE_CELL} + 1] AS cell_name FROM cx")
def a7_centre_cell(spark, d):
    return dense.centre_cell(masks(spark, d), HEIGHT, WIDTH, strict=False)


@query(with_(PX, REGION) + "SELECT img, k, region FROM re")
def a8_six_region(spark, d):
    return maskstats.six_region(_runs(spark, d), HEIGHT, WIDTH)


@query(with_(PX) + "SELECT img, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS region FROM (SELECT img, [" + ", ".join(f"sum(CASE WHEN {x} THEN k ELSE 0 END)" for x in _SIX) + "] AS l FROM px GROUP BY img)")
def a8_six_region_by_value(spark, d):
    return maskstats.six_region(_runs(spark, d), HEIGHT, WIDTH, by_class=False)


@query(with_(PX) + "SELECT img, r, c, max(k) AS k FROM (SELECT * FROM px UNION ALL SELECT img, r, 22 - c, k FROM px) GROUP BY img, r, c")
def a9_merge_max(spark, d):
    own = _runs(spark, d)
    return runs.to_pixels(runs.merge_max(own, own.withColumns({"c0": WIDTH - 1 - F.col("c1"), "c1": WIDTH - 1 - F.col("c0")})))


POLY = """po AS (
  SELECT p_partkey AS img, j + 1 AS inst, CAST((p_partkey + j) % 4 AS INTEGER) AS category_id,
         CAST((p_partkey * 3 + 7 * j) % 12 AS INTEGER) AS x, CAST((p_size + 5 * j) % 10 AS INTEGER) AS y,
         CAST(4 + (p_partkey + j) % 8 AS INTEGER) AS w, CAST(4 + (p_size + j) % 6 AS INTEGER) AS h, CAST(p_partkey % 3 AS INTEGER) AS t
  FROM part, unnest(range(0, 3)) a(j)),
pt AS (SELECT img, inst, category_id, [x, x + w, x + w - 1, x + 1] AS xs, [y, y + t, y + h, y + h - 1] AS ys FROM po)"""
RASTER = (
    POLY
    + """,
ed AS (SELECT img, inst, category_id, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM pt, unnest([1, 2, 3, 4]) e(i)),
hit AS (
  SELECT img, inst, category_id, r, c,
         sum(CASE WHEN (y1 > r) <> (y2 > r) AND CASE WHEN y2 > y1 THEN s > 0 ELSE s < 0 END THEN 1 ELSE 0 END) AS n,
         max(s = 0 AND c BETWEEN least(x1, x2) AND greatest(x1, x2) AND r BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onit
  FROM (SELECT *, (x2 - x1) * (r - y1) - (c - x1) * (y2 - y1) AS s FROM ed, unnest(range(0, 20)) a(r), unnest(range(0, 23)) b(c))
  GROUP BY img, inst, category_id, r, c)"""
)


@query(with_(POLY) + "SELECT img, category_id, min(inst) - 1 AS ord, string_agg(array_to_string([xs[1], ys[1], xs[2], ys[2], xs[3], ys[3], xs[4], ys[4]], ','), ';' ORDER BY inst) AS polygons FROM pt GROUP BY img, category_id")
def a10_group_polygons(spark, d):
    out = raster.group_polygons(polygons(spark, d))
    return out.select("img", "category_id", "ord", F.array_join(F.transform("polygons", lambda p: F.array_join(p.cast("array<string>"), ",")), ";").alias("polygons"))


@query("SELECT user_id, round(avg(value), 6) AS mean_loss FROM events GROUP BY user_id")
def a11_mean_loss(spark, d):
    return rows.mean_loss(table(spark, d, "events"), "user_id", "value").withColumn("mean_loss", F.round("mean_loss", 6))


@query("SELECT user_id, round(sum(value * (1 + event_id % 8)) / sum(1 + event_id % 8), 6) AS weighted_loss FROM events GROUP BY user_id")
def a12_weighted_loss(spark, d):
    return rows.weighted_loss(table(spark, d, "events"), "user_id", "value", 1 + F.col("event_id") % 8).withColumn("weighted_loss", F.round("weighted_loss", 6))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id")
def a13_concat_outputs(spark, d):
    events = table(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    out = rows.concat_outputs(events, "user_id", ["ts", "event_id"], ["id", "event_type"])
    return out.select("user_id", F.array_join("id", ",").alias("ids"), F.array_join("event_type", ",").alias("kinds"))


@query("SELECT label, CAST(i AS INTEGER) AS dim, round(sum(embedding[i + 1]::DOUBLE * m) / greatest(sum(m), 1e-9), 6) AS mean FROM (SELECT label, embedding, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY label, i")
def a14_masked_mean(spark, d):
    e = table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return rows.masked_mean(e, "label", "embedding", "mask").withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(e[i] / list_sum(e), 9) AS weight FROM (SELECT vec_id, list_transform(embedding, lambda x: exp((x - list_max(embedding))::DOUBLE)) AS e, unnest(range(1, 65)) AS i FROM embeddings)")
def a15_softmax(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(rows.softmax(F.col("embedding"))).alias("dim", "weight"))
    return out.withColumn("weight", F.round("weight", 9))


@query("SELECT doc_id, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN list_contains([quality + 1, toxic * 3], i) THEN 1 ELSE 0 END), '') AS hot FROM labels")
def a16_multi_hot(spark, d):
    ids = table(spark, d, "labels").select("doc_id", F.array(F.col("quality") + 1, F.col("toxic") * 3).alias("labels"))
    return transforms.multi_label(ids, 4).select("doc_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("hot"))


@query("SELECT n_nationkey, concat_ws('、', n_name, r_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey")
def a17_join_names(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", captions.join_names([F.col("n_name"), F.col("r_name")], QA["list"]).alias("names"))


_SAID = "CASE WHEN (r + c) % 7 = 0 THEN 0 WHEN r = 5 THEN (k + 1) % 11 ELSE k END"


@query(
    with_(PX)
    + f""", pr AS (SELECT img, k, {_SAID} AS p FROM px),
cl AS (SELECT DISTINCT img, k AS l FROM pr UNION SELECT DISTINCT img, p FROM pr),
n AS (SELECT cl.img, l, count(*) FILTER (WHERE k = l AND p = l) AS tp, count(*) FILTER (WHERE k = l) AS t, count(*) FILTER (WHERE p = l) AS s FROM cl JOIN pr ON pr.img = cl.img GROUP BY cl.img, l),
m AS (SELECT *, CASE WHEN s = 0 THEN 1.0 ELSE tp / s END AS pc, CASE WHEN t = 0 THEN 1.0 ELSE tp / t END AS rc, CASE WHEN t + s - tp = 0 THEN 1.0 ELSE tp / (t + s - tp) END AS iou FROM n)
SELECT img, round(sum(tp) / sum(t), 6) AS pixel_accuracy, round(avg(pc), 6) AS precision, round(avg(rc), 6) AS recall,
  round(avg(CASE WHEN pc + rc = 0 THEN 0 ELSE 2 * pc * rc / (pc + rc) END), 6) AS f1, round(avg(iou), 6) AS iou, round(sum(t * iou) / sum(t), 6) AS fw_iou
FROM m GROUP BY img"""
)
def a18_segmentation_metrics(spark, d):
    out = maskstats.segmentation_metrics(pixels(spark, d).withColumn("p", F.expr(_SAID)))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "img"})


@query(with_(PX, COMP, recursive=True) + "SELECT img, k, CAST(s // 23 AS INTEGER) AS first_r, CAST(s % 23 AS INTEGER) AS first_c, n, sum_r, sum_c FROM co")
def b1_components(spark, d):
    return dense.component_rows(masks(spark, d))


@query(with_(PX, COMP, recursive=True) + "SELECT img, k, CAST(s // 23 AS INTEGER) AS first_r, CAST(s % 23 AS INTEGER) AS first_c, n, sum_r, sum_c FROM co")
def b1_tiled_components(spark, d):
    """The same components from tiles of 4 x 5 pixels."""
    return tiles.tiled_components(tiles.tiles_of(masks(spark, d), 4, 5))


@query(ORACLE["b1_components"])
def b1_run_components(spark, d):
    """The same components from runs, row by row of an image."""
    return run_shapes.run_components(_runs(spark, d))


_DISK = ", ".join(str(x) for x in kernels.DISK2)


@query(with_(PX) + f"SELECT DISTINCT img, r + dr AS r, c + dc AS c FROM px JOIN (VALUES {_DISK}) o(dr, dc) ON px.k = 1 WHERE r + dr BETWEEN 0 AND 19 AND c + dc BETWEEN 0 AND 22")
def b2_dilation(spark, d):
    return dense.to_pixels(dense.map_masks(masks(spark, d), lambda s: kernels.dilate(s == 1).astype("int16"))).filter("k > 0").drop("k")


def _parts(of: str, name: str, reach: int, width: int = 23) -> str:
    """Components of the pixels ``of`` (img, k, r, c; rows of ``width``), as runs of neighbours in a row that touch those of the next, diagonally too if ``reach`` is 1."""
    return f"""{name}r AS (SELECT img, k, r, min(c) AS a, max(c) AS b FROM (SELECT *, c - row_number() OVER (PARTITION BY img, k, r ORDER BY c) AS g FROM {of}) GROUP BY img, k, r, g),
{name}e AS (SELECT x.img, x.k, x.r, x.a, y.r AS r2, y.a AS a2 FROM {name}r x JOIN {name}r y ON x.img = y.img AND x.k = y.k AND abs(x.r - y.r) = 1 AND x.a <= y.b + {reach} AND y.a <= x.b + {reach}),
{name}s AS (SELECT img, k, r * {width} + a AS s, r, a FROM {name}r x WHERE NOT EXISTS (SELECT 1 FROM {name}e e WHERE e.img = x.img AND e.k = x.k AND e.r = x.r AND e.a = x.a AND e.r2 < x.r)
  UNION SELECT e.img, e.k, s.s, e.r2, e.a2 FROM {name}s s JOIN {name}e e ON e.img = s.img AND e.k = s.k AND e.r = s.r AND e.a = s.a),
{name}l AS (SELECT img, k, r, a, b, min(s) AS s FROM {name}s JOIN {name}r USING (img, k, r, a) GROUP BY ALL),
{name}z AS (SELECT *, sum(b - a + 1) OVER (PARTITION BY img, k, s) AS n FROM {name}l)"""


def _left_sql(source: str, threshold: float, *more: str) -> str:
    """Pixels ``le`` (img, k, r, c) that dilation, filled holes and dropped parts leave of each class of ``source`` (img, k, r, c), and CTEs on them."""
    return with_(
        PX,
        f"so AS ({source})",
        f"di AS (SELECT DISTINCT img, k, r + dr AS r, c + dc AS c FROM so JOIN (VALUES {_DISK}) o(dr, dc) ON true WHERE r + dr BETWEEN 0 AND 19 AND c + dc BETWEEN 0 AND 22)",
        "cells AS (SELECT img, k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT img, k FROM so), unnest(range(0, 20)) x(r), unnest(range(0, 23)) y(c))",
        "ou AS (SELECT * FROM cells ANTI JOIN di USING (img, k, r, c))",
        _parts("ou", "h", 0),
        "fi AS (SELECT img, k, r, c FROM di UNION SELECT img, k, r, CAST(unnest(range(a, b + 1)) AS INTEGER) FROM hz WHERE n < 10)",
        _parts("fi", "g", 1),
        f"le AS (SELECT img, k, r, CAST(unnest(range(a, b + 1)) AS INTEGER) AS c FROM gz WHERE n >= {threshold} * 460)",
        *more,
        recursive=True,
    )


def _clean_sql(source: str, threshold: float, value: str) -> str:
    """Of what is left of each class, the greatest ``value``."""
    return _left_sql(source, threshold) + f"SELECT img, r, c, max({value}) AS k FROM le GROUP BY img, r, c"


def _border_sql(source: str, threshold: float, value: str, name: str) -> str:
    """Pixels left of each class with a side on what lies around all of it: on a grid one wider all around, the outside is the part with the corner."""
    return (
        _left_sql(
            source,
            threshold,
            "pad AS (SELECT img, k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT img, k FROM le), unnest(range(0, 22)) x(r), unnest(range(0, 25)) y(c))",
            "un AS (SELECT * FROM pad ANTI JOIN (SELECT img, k, r + 1 AS r, c + 1 AS c FROM le) USING (img, k, r, c))",
            _parts("un", "u", 0, 25),
            "ar AS (SELECT img, k, r - 1 AS r, CAST(unnest(range(a, b + 1)) AS INTEGER) - 1 AS c FROM uz WHERE s = 0)",
        )
        + f"SELECT img, {value} AS {name}, r, c FROM (SELECT DISTINCT le.* FROM le JOIN ar ON ar.img = le.img AND ar.k = le.k AND abs(ar.r - le.r) + abs(ar.c - le.c) = 1)"
    )


_ONE = "SELECT * FROM px WHERE k = 1"


def _left(out: DataFrame) -> DataFrame:
    return dense.to_pixels(out).filter("k > 0")


@query(_clean_sql(_ONE, 0.001, "255"))
def b2_binary_postprocess(spark, d):
    return _left(dense.map_masks(masks(spark, d), lambda s: kernels.postprocess(s == 1)))


@query(_clean_sql(_ONE, 0.1, "255"))
def b2_binary_postprocess_tenth(spark, d):
    return _left(dense.map_masks(masks(spark, d), lambda s: kernels.postprocess(s == 1, 0.1)))


@query(_clean_sql(_ONE, 0.01, "255"))
def b3_postprocess_one_percent(spark, d):
    return _left(dense.map_masks(masks(spark, d), lambda s: kernels.postprocess(s == 1, 0.01)))


@query(_clean_sql("SELECT * FROM px WHERE k > 0", 0.001, "k"))
def b4_postprocess_classes(spark, d):
    return _left(dense.map_masks(masks(spark, d), kernels.postprocess_classes))


@query(with_(PX, DIM) + "SELECT p.img, d.label_id, d.label_name, count(*) AS pixels, string_agg(px.r * 23 + px.c, ',' ORDER BY px.r, px.c) FILTER (WHERE px.k = d.label_id) AS ones FROM (SELECT DISTINCT img, k FROM px) p JOIN dim d ON d.label_id = p.k JOIN px ON px.img = p.img GROUP BY ALL")
def b5_binary_masks(spark, d):
    out = dense.binary_masks(masks(spark, d), label_dim(spark, "qa"))
    ones = F.filter(F.sequence(F.lit(0), F.size("mask") - 1), lambda i: F.get("mask", i) == 1)
    return out.select("img", "label_id", "label_name", F.size("mask").cast("long").alias("pixels"), F.array_join(ones.cast("array<string>"), ",").alias("ones"))


def _clean_runs(spark, d, threshold, *classes):
    own = _runs(spark, d)
    out = run_shapes.postprocessed(own.filter(F.col("k").isin(*classes)) if classes else own, masks(spark, d).select("img", "h", "w"), threshold)
    return runs.to_pixels(out)


@query(_clean_sql(_ONE, 0.1, "1"))
def b2_postprocess_runs(spark, d):
    """Clean-up of one class where an image may be larger than a row, without its 255."""
    return _clean_runs(spark, d, 0.1, 1)


@query(_clean_sql("SELECT * FROM px WHERE k > 0", 0.001, "k"))
def b4_postprocess_runs(spark, d):
    return _clean_runs(spark, d, 0.001)


def model_results(spark, d):
    """Three results for each image: a class, another class, the background."""
    m = masks(spark, d)
    part = lambda name, k: m.select("img", F.lit(name).alias("label"), "h", "w", F.transform("mask", lambda x: (x == k).cast("short")).alias("mask"))
    return part("云", 1).unionByName(part("模糊", 7)).unionByName(part("背景", 0))


_RESULT_ID = f"CASE WHEN k = 1 THEN {LABEL2ID['云']} ELSE {LABEL2ID['模糊']} END"


@query(_clean_sql("SELECT * FROM px WHERE k IN (1, 7)", 0.001, _RESULT_ID))
def b6_semantic_merge(spark, d):
    return _left(dense.semantic_merge(model_results(spark, d), LABEL2ID))


@query(with_(RASTER) + "SELECT img, r, c, max(inst) AS inst FROM hit WHERE n % 2 = 1 OR onit GROUP BY img, r, c")
def b7_instance_mask(spark, d):
    return raster.instance_mask(polygons(spark, d), HEIGHT, WIDTH)


@query(with_(POLY) + "SELECT img, inst, category_id + 1 AS class FROM po UNION ALL SELECT DISTINCT img, 0, 0 FROM po")
def b7_instance_classes(spark, d):
    return raster.instance_classes(polygons(spark, d))


_SEMANTIC = "SELECT img, r, c, max(category_id) AS k FROM (SELECT img, category_id, r, c FROM hit WHERE {} GROUP BY img, category_id, r, c HAVING sum(n) % 2 = 1 OR max(onit)) GROUP BY img, r, c HAVING max(category_id) > 0"


@query(with_(RASTER) + _SEMANTIC.format("true"))
def b8_semantic_mask(spark, d):
    return raster.semantic_mask(polygons(spark, d), HEIGHT, WIDTH)


def _instances(spark, d, sparse=False):
    m = masks(spark, d)
    if sparse:  # instances of even ids where the image's number is odd, and none above 6 in every third image
        m = m.withColumn("mask", F.transform("mask", lambda x: F.when((x % 2 == F.col("img") % 2) | ((x > 6) & (F.col("img") % 3 == 0)), 0).otherwise(x).cast("short")))
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("img"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("id"))
    return dense.instance_polygons(m, ids.withColumn("class", (F.col("id") + F.col("img") % 3).cast("int")))


@query()
def b9_instance_polygons(spark, d):
    return _instances(spark, d)


_SPARSE = "sp AS (SELECT DISTINCT img, k FROM px WHERE k > 0 AND k % 2 <> img % 2 AND NOT (k > 6 AND img % 3 = 0)), mo AS (SELECT img, unnest(range(1, max(k) + 1)) AS id FROM sp GROUP BY img)"


@query(
    with_(PX, _SPARSE) + f"SELECT mo.img, CAST(mo.id AS INTEGER) AS id, k IS NOT NULL AS present, CAST(CASE WHEN k IS NOT NULL THEN mo.id + mo.img % 3 - 1 END AS INTEGER) AS category_id, CASE WHEN k IS NULL THEN '0,0,{WIDTH},0,{WIDTH},{HEIGHT},0,{HEIGHT}' END AS whole "
    "FROM mo LEFT JOIN sp ON sp.img = mo.img AND sp.k = mo.id"
)
def b9_missing_instances(spark, d):
    """Every id up to an image's greatest, those without a pixel as the whole image."""
    return _instances(spark, d, sparse=True).select("img", "id", "present", "category_id", F.when(~F.col("present"), F.array_join("points", ",")).alias("whole"))


@query()
def b10_result_polygons(spark, d):
    return dense.result_polygons(model_results(spark, d), LABEL2ID)


@query()
def b10_result_polygons_one_percent(spark, d):
    return dense.result_polygons(model_results(spark, d), LABEL2ID, 0.01)


@query()
def b11_semantic_polygons(spark, d):
    return dense.semantic_polygons(masks(spark, d))


#: The label of the background is no ``background`` and so has a category.
_RESULT_CATEGORY = f"CASE WHEN k = 0 THEN {LABEL2ID['背景']} ELSE {_RESULT_ID} END - 1"


@query(_border_sql("SELECT * FROM px WHERE k IN (0, 1, 7)", 0.001, _RESULT_CATEGORY, "category_id"))
def b10_border_pixels(spark, d):
    """The result polygons of ``b10_result_polygons``, walked along their lines."""
    return dense.walked(dense.result_polygons(model_results(spark, d), LABEL2ID), ["img", "category_id"], swapped=True)


@query(_border_sql("SELECT * FROM px WHERE k IN (0, 1, 7)", 0.01, _RESULT_CATEGORY, "category_id"))
def b10_border_pixels_one_percent(spark, d):
    return dense.walked(dense.result_polygons(model_results(spark, d), LABEL2ID, 0.01), ["img", "category_id"], swapped=True)


@query(_border_sql("SELECT * FROM px WHERE k > 0", 0.0, "k", "id"))
def b11_border_pixels(spark, d):
    """The class polygons of ``b11_semantic_polygons``, walked along their lines."""
    return dense.walked(dense.semantic_polygons(masks(spark, d)), ["img", "id"], apart=True)


@query(with_(PX) + "SELECT img, CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c, k FROM unnest(range(0, 31)) a(r), unnest(range(0, 17)) b(c), px WHERE px.r = a.r * 20 // 31 AND px.c = b.c * 23 // 17")
def b12_resize_nearest(spark, d):
    return dense.to_pixels(dense.resize_nearest(masks(spark, d), 31, 17))


#: For each row and column of 31 x 17 the two source pixels and the weight of the second, from 20 x 23.
BETWEEN = """ys AS (SELECT CAST(r AS INTEGER) AS tr, CAST(floor(y) AS INTEGER) AS y0, CAST(least(floor(y) + 1, 19) AS INTEGER) AS y1, y - floor(y) AS fy FROM (SELECT r, greatest(0, least(19, (r + 0.5::DOUBLE) * 20 / 31 - 0.5::DOUBLE)) AS y FROM unnest(range(0, 31)) a(r))),
xs AS (SELECT CAST(c AS INTEGER) AS tc, CAST(floor(x) AS INTEGER) AS x0, CAST(least(floor(x) + 1, 22) AS INTEGER) AS x1, x - floor(x) AS fx FROM (SELECT c, greatest(0, least(22, (c + 0.5::DOUBLE) * 23 / 17 - 0.5::DOUBLE)) AS x FROM unnest(range(0, 17)) b(c)))"""


def _blend(value: Callable[[str, str], str]) -> str:
    """Bilinear value from SQL for a source pixel's value at (row, column)."""
    return f"(({value('y0', 'x0')}) * (1 - fx) + ({value('y0', 'x1')}) * fx) * (1 - fy) + (({value('y1', 'x0')}) * (1 - fx) + ({value('y1', 'x1')}) * fx) * fy"


def _class_at(r: str, c: str) -> str:
    v = f"((({r}) // 4) * 3 + (({c}) // 5) * 5 + p_partkey * 7 + p_size) % 17"
    return f"CASE WHEN {v} < 11 THEN {v} ELSE 0 END"


@query(with_(BETWEEN) + f"SELECT p_partkey AS img, tr AS r, tc AS c, round({_blend(_class_at)}, 6) AS v FROM part, ys, xs")
def b12_resize_bilinear(spark, d):
    at = dense.resize_bilinear(masks(spark, d), 31, 17).select("img", "w", F.posexplode("mask").alias("i", "v"))
    return at.select("img", F.expr("CAST(i DIV w AS INT)").alias("r"), (F.col("i") % F.col("w")).alias("c"), F.round("v", 6).alias("v"))


_COIN = "CAST('0x' || substr(md5(concat_ws('|', img, '{}')), 1, 8) AS BIGINT) < 2147483648"
FLIPPED = f"fl AS (SELECT img, CASE WHEN {_COIN.format('v')} THEN 19 - r ELSE r END AS r, CASE WHEN {_COIN.format('h')} THEN 22 - c ELSE c END AS c, k FROM px)"


@query(with_(PX, FLIPPED) + "SELECT img, r, c, k FROM fl")
def b13_flips(spark, d):
    return transforms.segmentation(pixels(spark, d), HEIGHT, WIDTH, aug=True).drop("target_size")


@query()
def b13_noise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", rows.gaussian_noise(F.col("embedding"), F.col("vec_id"), 42, 0.1).alias("noisy"))


def _caption_sql(language: str) -> str:
    t = CAPTION[language]
    said = f"CASE WHEN area > 0.3 THEN {quoted(t['large'])} || label_name WHEN area > 0.001 THEN {quoted(t['small'])} || label_name END"
    return f"SELECT img, CASE WHEN count(said) = 0 THEN {quoted(t['none'])} ELSE {quoted(t['start'])} || string_agg(said, {quoted(t['join'])} ORDER BY k) || {quoted(t['end'])} END AS caption FROM (SELECT img, k, CASE WHEN k <> 0 THEN {said} END AS said FROM ar JOIN dim ON label_id = k) GROUP BY img"


def _captions(spark, d, language="zh"):
    return captions.id_captions(maskstats.area_ratio(_runs(spark, d)), NAMES, language)


@query(with_(PX, DIM, AREA) + _caption_sql("zh"))
def e1_caption(spark, d):
    return _captions(spark, d)


@query(with_(PX, DIM, AREA) + _caption_sql("en"))
def e1_caption_en(spark, d):
    return _captions(spark, d, "en")


@query(with_(PX, DIM, AREA, f"ca AS ({_caption_sql('zh')})") + "SELECT img, string_agg(label_name, '/' ORDER BY label_id) AS names, string_agg(CAST(label_id AS VARCHAR), '/' ORDER BY label_id) AS ids FROM ca LEFT JOIN dim ON contains(caption, label_name) AND NOT contains(caption, '合格') GROUP BY img")
def e2_caption_to_ids(spark, d):
    found = captions.caption_ids(_captions(spark, d), LABEL2ID)
    text = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x.cast("string")), "/"), F.lit(""))
    return found.select("img", text("label_names").alias("names"), text("category_ids").alias("ids"))


ERRORS = {"云": "cloud", "阴影": "shadow", "模糊": "blur", "拉花": "streaking"}
_ERRORS = list(ERRORS)
_ERROR_LIST = f"CASE WHEN doc_id % 5 = 0 THEN [] ELSE [{sql_list(_ERRORS)}[1 + doc_id % 4], {sql_list(_ERRORS)}[1 + doc_id % 3], '其他'] END"


@query(f"SELECT doc_id, 'Is there any error? ' || CASE WHEN len(l) = 0 THEN 'no error' ELSE array_to_string(l, ', ') END AS caption FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform({_ERROR_LIST}, lambda x: CASE x " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in ERRORS.items()) + " END), lambda y: y IS NOT NULL))) AS l FROM documents)")
def e3_error_caption(spark, d):
    names = F.array(*map(F.lit, _ERRORS))
    pick = lambda n: F.get(names, (F.col("doc_id") % n).cast("int"))
    found = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(4), pick(3), F.lit("其他")))
    docs = table(spark, d, "documents").select("doc_id", found.alias("错误描述"))
    return captions.error_captions(docs, ERRORS, need_question=True).select("doc_id", "caption")


def _attributes(spark, d):
    """img, k and all attributes of every class: one pass for the counts, one for the components."""
    found = dense.component_rows(masks(spark, d))
    place = F.struct("first_r", "first_c", (F.col("sum_c") / F.col("n")).cast("int").alias("x"), (F.col("sum_r") / F.col("n")).cast("int").alias("y"))
    comps = found.groupBy("img", "k").agg((F.count("*") + 1).alias("num"), F.min(place).alias("p"))
    centre = F.expr(f"CAST(p.y DIV {H3} * 3 + p.x DIV {W3} AS INT)")
    comps = comps.select("img", "k", "num", F.when(centre <= 8, centre).alias("centre_cell"))
    both = maskstats.class_statistics(_runs(spark, d), list(NAMES), HEIGHT, WIDTH).join(comps.hint("merge"), ["img", "k"], "left")
    return both.withColumn("num", F.coalesce("num", F.lit(1)))


def _qa_sql() -> str:
    q, n = QA, quoted
    word = "CASE " + " ".join(f"WHEN area > {a} THEN {n(t)}" for a, t in AREA_WORDS) + " END"
    names = lambda f: ", ".join(map(n, FAMILIES[f]))
    answer = f"""CASE WHEN area = 0 THEN {n(q["absent"])} || label_name || {n(q["stop"])}
  WHEN label_name IN ({names("area")}) THEN CASE WHEN area > {AREA_WORDS[0][0]} THEN {n(q["all"])} || label_name || {n(q["stop"])}
    ELSE CASE WHEN area > {AREA_WORDS[-2][0]} THEN {n(q["there"])} ELSE {n(q["maybe"])} END || CASE WHEN num > 1 THEN {n(q["many"])} ELSE {n(q["one"])} END || {word} || label_name || {n(q["mostly"])} || area_name END
  WHEN label_name IN ({names("seam")}) THEN {n(q["there"] + q["seam"])} || label_name || {n(q["seam_trace"])} || centre_name || {n(q["seam_is"])} || CASE WHEN w > h THEN {n(q["across"])} ELSE {n(q["upright"])} END || {n(q["seam_end"])}
  ELSE {n(q["there"])} || num || {n(q["places"])} || label_name || {n(q["mostly"])} || area_name || {n(q["stop"])} END"""
    return (
        with_(PX, DIM, AREA, ALL, BOX, CELL, COMP, CENTRE, recursive=True)
        + f""", att AS (SELECT al.img, al.k, al.area, label_name, coalesce(nm.num, 1) AS num, w, h, {sql_list(CELLS)}[cell + 1] AS area_name, coalesce({sql_list(CELLS)}[{_CENTRE_CELL.replace("y //", "cx.y //").replace("x //", "cx.x //").replace("ccx", "cx")} + 1], {n(NO_CELL)}) AS centre_name
  FROM al JOIN dim ON label_id = al.k LEFT JOIN bx ON bx.img = al.img AND bx.k = al.k LEFT JOIN ce ON ce.img = al.img AND ce.k = al.k LEFT JOIN cx ON cx.img = al.img AND cx.k = al.k
  LEFT JOIN (SELECT img, k, count(*) + 1 AS num FROM co GROUP BY img, k) nm ON nm.img = al.img AND nm.k = al.k)
SELECT img, CAST(k AS INTEGER) AS pos, {n(q["ask"])} || label_name || {n(q["ask_end"])} AS question, {answer} AS answer FROM att
UNION ALL SELECT img, 0, {n(q["overall"])}, CASE WHEN count(*) FILTER (WHERE area <> 0) = 0 THEN {n(q["overall_no"])} ELSE {n(q["overall_yes"])} || string_agg(label_name, {n(q["list"])} ORDER BY k) FILTER (WHERE area <> 0) || {n(q["stop"])} END FROM att GROUP BY img"""
    )


@query(_qa_sql())
def e5_mask_to_qa(spark, d):
    return captions.attribute_answers(_attributes(spark, d), NAMES)


@query(with_(PX, REGION) + f"SELECT img, k, {quoted(TITLE[0] + '拼接错误' + TITLE[1])} || {sql_list(REGIONS)}[region + 1] || {quoted(TITLE[2])} || {sql_list(LINES)}[region + 1] || {quoted(TITLE[3])} AS title FROM re")
def e6_region_title(spark, d):
    return maskstats.six_region(_runs(spark, d), HEIGHT, WIDTH).select("img", "k", captions.region_title(F.col("region")).alias("title"))


_RANK = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
MARKED = f"""wo AS (SELECT doc_id, ws, len(ws) AS n, least(len(ws), 1 + {_RANK.format("concat_ws('|', doc_id, 'q')")} % CAST(floor(0.3 * len(ws) + 1) AS BIGINT)) AS q FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM base)),
ex AS (SELECT doc_id, q, ws[i + 1] AS word, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', doc_id, i)), i) AS rk FROM (SELECT doc_id, ws, q, unnest(range(0, n)) AS i FROM wo)),
ma AS (SELECT doc_id, string_agg(CASE WHEN rk <= q THEN {sql_list(MARKS)}[1 + {_RANK.format("concat_ws('|', doc_id, i, 'm')")} % 6] || ' ' || word ELSE word END, ' ' ORDER BY i) AS text FROM ex GROUP BY doc_id)"""


@query(with_("base AS (SELECT doc_id, text FROM documents)", MARKED) + "SELECT doc_id, md5(text) AS text_md5 FROM ma")
def e7_insert_marks(spark, d):
    return dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(rows.insert_marks(F.col("text"), F.col("doc_id"))).alias("text_md5"))


DROPPED = "ke AS (SELECT doc_id, quality FROM labels WHERE quality <> 0 UNION ALL SELECT doc_id, quality FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk, count(*) OVER () AS n FROM labels WHERE quality = 0) WHERE rk > round_even(n * 0.9, 0))"


@query(with_(DROPPED) + "SELECT doc_id, quality FROM ke")
def e8_drop_share(spark, d):
    return rows.drop_share(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(with_(DROPPED, "base AS (SELECT doc_id, text FROM documents JOIN ke USING (doc_id))", MARKED) + "SELECT ma.doc_id, quality, md5(text) AS text_md5 FROM ma JOIN ke ON ke.doc_id = ma.doc_id")
def e9_augment(spark, d):
    both = dealt(table(spark, d, "documents").select("doc_id", "text")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.augment(both, "text", "doc_id", label="quality").select("doc_id", "quality", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, split_part('Is ' || source || ' fine? ' || lang || '? yes', '? ', 1) || '?' AS prompt FROM documents")
def e10_question_prefix(spark, d):
    text = F.concat(F.lit("Is "), "source", F.lit(" fine? "), "lang", F.lit("? yes"))
    return table(spark, d, "documents").select("doc_id", captions.question_prefix(text).alias("prompt"))


@query(with_(PX, BOX, AREA) + "SELECT bx.img AS image_id, bx.k AS category_id, 0 AS \"isCrowd\", area, x, y, w, h FROM bx JOIN ar ON ar.img = bx.img AND ar.k = bx.k")
def e11_coco_annotations(spark, d):
    px = _runs(spark, d)
    each = maskstats.bounding_box(px).join(maskstats.area_ratio(px).hint("merge"), ["img", "k"])
    lists = each.groupBy(F.col("img").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("k", "area", F.array("x", "y", "w", "h").alias("bbox")))).alias("z"))
    lists = lists.select("image_id", *[F.col(f"z.{n}").alias(c) for n, c in (("k", "category_id"), ("area", "area"), ("bbox", "bbox"))])
    flat = transforms.detection(lists).select(F.explode("annotations").alias("a")).select("a.*")
    return flat.select("image_id", "category_id", "isCrowd", "area", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")])


@query("SELECT vec_id, [" + ", ".join(str(i * 7 % 64) for i in range(64)) + "][list_position(embedding, list_max(embedding))] AS label_id FROM embeddings")
def e12_logits_to_ids(spark, d):
    return table(spark, d, "embeddings").select("vec_id", rows.arg_max_label(F.col("embedding"), [i * 7 % 64 for i in range(64)]).alias("label_id"))


@query(with_(PX, DIM) + "SELECT img, label_name, n FROM (SELECT img, k, count(*) AS n FROM px GROUP BY img, k) JOIN dim ON label_id = k")
def j1_strict_lookup(spark, d):
    n = maskstats.area_ratio(_runs(spark, d)).select("img", F.col("k").alias("label_id"), "n")
    return maskstats.strict_lookup(n, label_dim(spark, "qa"), "label_id").select("img", "label_name", "n")


_SEG = "(" + ", ".join(f"({i}, {quoted(n)})" for i, n in VOCABULARIES["segmenter"].items()) + ")"


@query(with_(PX) + f"SELECT img, label_name, n FROM (SELECT img, k, count(*) AS n FROM px GROUP BY img, k) JOIN (VALUES {_SEG[1:-1]}) t(label_id, label_name) ON label_id = k")
def j2_lookup_known(spark, d):
    n = maskstats.area_ratio(_runs(spark, d)).select("img", F.col("k").alias("label_id"), "n")
    return rows.inner_lookup(n, label_dim(spark, "segmenter").select("label_id", "label_name"), "label_id").select("img", "label_name", "n")


@query("SELECT vec_id, CAST(i AS INTEGER) AS pos, embedding[i + 1] AS x, i * 2 AS y FROM (SELECT vec_id, embedding, unnest(range(0, 5)) AS i FROM embeddings)")
def j3_zip_shortest(spark, d):
    two = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i * 2).alias("y"))
    return rows.zip_shortest(two, "x", "y")


@query("SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal ELSE s.s_acctbal END AS c_acctbal FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def j4_overlay(spark, d):
    patch = table(spark, d, "supplier").select(F.concat(F.lit("_orig_mod."), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").alias("c_acctbal"))
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_acctbal")
    return rows.overlay(base, patch, "key", "c_acctbal", "_orig_mod.").select(F.col("key").cast("long").alias("c_custkey"), "c_acctbal")


@query("SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def j5_invert_map(spark, d):
    return rows.invert_map(table(spark, d, "nation"), "n_name", "n_regionkey", "n_nationkey")


@query("SELECT p_partkey, id, max(l) AS label_id FROM (SELECT p_partkey, CAST(i % 3 AS INTEGER) AS id, CAST(i * 10 + p_size AS INTEGER) AS l FROM part, unnest(range(0, 5)) a(i)) GROUP BY p_partkey, id")
def j6_segments_map(spark, d):
    infos = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i % 3).alias("id"), (i * 10 + F.col("p_size")).alias("label_id")))
    return table(spark, d, "part").select("p_partkey", F.explode(rows.segments_to_map(infos)).alias("id", "label_id"))


@query(with_(PX) + "SELECT img, r, c, k FROM px WHERE k <> 0")
def p1_drop_background(spark, d):
    return maskstats.drop_background(pixels(spark, d)).select("img", "r", "c", "k")


@query(with_(POLY) + "SELECT img, string_agg(CAST(category_id AS VARCHAR), ',' ORDER BY inst) AS kept, sum(x) AS xs FROM po WHERE category_id IN (1, 3) GROUP BY img")
def p2_keep_categories(spark, d):
    out = rows.keep_categories(polygons(spark, d), [1, 3])
    return out.select("img", F.array_join(F.transform("category_id", lambda x: x.cast("string")), ",").alias("kept"), F.aggregate("points", F.lit(0), lambda a, p: a + F.get(p, F.lit(0))).alias("xs"))


@query(with_(PX) + "SELECT img, CASE WHEN k >= 6 THEN 0 ELSE k END AS k, count(*) AS n FROM px GROUP BY ALL")
def p3_clamp_classes(spark, d):
    return maskstats.clamp_classes(pixels(spark, d), 6).groupBy("img", "k").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def p4_drop_nulls(spark, d):
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.drop_null_rows(both)


@query("SELECT o_orderkey, list_sum(list_transform([o_custkey % 5, CASE WHEN o_orderkey % 3 = 0 THEN -100 ELSE 4 END], lambda x: CASE WHEN x = -100 THEN 1 ELSE x END)) AS total FROM orders")
def p5_replace_sentinel(spark, d):
    labels = F.array(F.col("o_custkey") % 5, F.when(F.col("o_orderkey") % 3 == 0, -100).otherwise(4).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", F.aggregate(rows.replace_sentinel(labels, 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT c_custkey, round_even(c_acctbal / 7, 5) AS v FROM customer")
def p6_round_values(spark, d):
    return rows.round_values(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("v")), ["v"])


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 18), lambda i: ((i % 6) * 3 + 2 - i // 6) * 5 + p_size), ',') AS image FROM part")
def p7_channels_first(spark, d):
    flat = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: i * 5 + F.col("p_size"))
    moved = rows.channels_first(flat, 2, 3, reverse=True)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(moved, lambda x: x.cast("string")), ",").alias("image"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '7'), c_custkey LIMIT 50")
def p8_random_rows(spark, d):
    return rows.random_rows(table(spark, d, "customer").select("c_custkey", "c_name"), 50, "c_custkey", "7")


@query(with_(POLY) + "SELECT img, CAST(inst AS INTEGER) AS inst, CAST(i - 1 AS INTEGER) AS pos, ys[i] AS x, xs[i] AS y FROM pt, unnest([1, 2, 3, 4]) e(i)")
def p10_pairs_swapped(spark, d):
    each = polygons(spark, d).select("img", F.posexplode("points").alias("i", "flat"))
    return each.select("img", (F.col("i") + 1).alias("inst"), F.posexplode(rows.pair_up(F.col("flat"), swap=True)).alias("pos", "p")).select("img", "inst", "pos", "p.x", "p.y")


_FILE = "'run' || CAST(o_custkey % 7 AS {0}) || '/' || CAST(o_orderkey % 1000 AS {0}) || CASE o_orderkey % 4 WHEN 0 THEN '.pt' WHEN 1 THEN '.pth' WHEN 2 THEN '.PTH' ELSE '.txt' END"


@query(
    "WITH f AS (SELECT " + _FILE.format("VARCHAR") + " AS path, 'run' || CAST(o_custkey % 7 AS VARCHAR) AS folder, o_orderkey * 7919 % 1000003 AS modified, o_orderkey % 50 + 1 AS length FROM orders), "
    "l AS (SELECT arg_max(folder, (modified, folder)) AS folder FROM f WHERE starts_with(folder, 'run')) "
    "SELECT path, modified, length FROM f JOIN l USING (folder) WHERE path LIKE '%.pt' OR path LIKE '%.pth' ORDER BY path DESC, modified DESC, length DESC LIMIT 1"
)
def s2_newest_checkpoint(spark, d):
    files = table(spark, d, "orders").selectExpr(_FILE.format("STRING") + " AS path", "o_orderkey * 7919 % 1000003 AS modified", "o_orderkey % 50 + 1 AS length")
    return rows.newest(files, "run")


@query("SELECT 'run-1' AS folder, CAST(sum(length(s_name) + 1) AS BIGINT) AS length FROM supplier WHERE s_suppkey % 2 = 1")
def s2_newest_folder(spark, d):
    """Two folders of files, written one after the other, and the file to load out of the later one."""
    names, top = table(spark, d, "supplier"), new_folder(spark, "runs")
    for k in (0, 1):
        names.filter(F.col("s_suppkey") % 2 == k).select("s_name").coalesce(1).write.text(f"{top}/run-{k}")
    found = rows.newest(checkpoints(spark, top), qualified(spark, top) + "/run-", (".txt",))
    return found.select(F.regexp_extract("path", r"/(run-\d)/", 1).alias("folder"), "length")


@query("SELECT n_nationkey AS label_id, n_name AS label_name FROM nation")
def s6_model_labels(spark, d):
    """A configuration file for each region, written and read again."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))))
    configs = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(entries.alias("id2label"))).alias("value"))
    folder = new_folder(spark, "configs")
    configs.write.partitionBy("n_regionkey").text(folder)
    return model_labels(spark, folder)


@query(
    with_(POLY) + "SELECT img, CAST(inst - 1 AS BIGINT) AS ord, CAST(category_id AS BIGINT) AS category_id, CAST(list_min(xs) AS DOUBLE) AS x0, CAST(list_min(ys) AS DOUBLE) AS y0, CAST(list_max(xs) AS DOUBLE) AS x1, CAST(list_max(ys) AS DOUBLE) AS y1, "
    "abs(list_sum([xs[i] * ys[i % 4 + 1] - xs[i % 4 + 1] * ys[i] for i in [1, 2, 3, 4]]))::DOUBLE AS twice_area, array_to_string(list_sort([xs[i] * 100 + ys[i] for i in [1, 2, 3, 4]]), ',') AS corners FROM pt"
)
def s5_shapefiles(spark, d):
    """Polygons written as shapefiles and read again."""
    each = polygons(spark, d).select("img", F.posexplode(F.arrays_zip("points", "category_id")).alias("ord", "z")).select("img", "ord", "z.category_id", F.col("z.points").alias("points"))
    folder = new_folder(spark, "shapes")
    write_shapefiles(each, folder)
    back = read_shapefiles(spark, folder, ["img", "ord", "category_id"]).withColumn("p", rows.pair_up(F.col("points")))
    nth = lambda i: F.get("p", i % F.size("p"))
    area = F.aggregate(F.transform("p", lambda a, i: a["x"] * nth(i + 1)["y"] - nth(i + 1)["x"] * a["y"]), F.lit(0.0), lambda a, v: a + v)
    at = lambda c: F.transform("p", lambda v: v[c])
    corners = F.array_join(F.sort_array(F.transform("p", lambda v: (v["x"] * 100 + v["y"]).cast("int"))), ",")
    return back.select("img", "ord", "category_id", F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1"), F.abs(area).alias("twice_area"), corners.alias("corners"))


@query(
    "WITH o AS (SELECT doc_id, list_transform(range(1, 5), lambda i: CASE WHEN list_contains([quality + 1, toxic * 3], i) THEN 1 ELSE 0 END) AS hot, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels) "
    "SELECT pos // 32 AS batch, CAST(count(*) AS INTEGER) AS n, string_agg(doc_id, ',' ORDER BY pos) AS images, string_agg(array_to_string(hot, ''), ',' ORDER BY pos) AS labels FROM o GROUP BY pos // 32"
)
def u7_classification_batches(spark, d):
    source = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("image"), F.array(F.col("quality") + 1, F.col("toxic") * 3).alias("labels"))
    out = batches.classification_batches(transforms.multi_label(source, 4), ["doc_id"], 32)
    hot = F.transform("labels", lambda x: F.array_join(F.transform(x, lambda v: v.cast("int").cast("string")), ""))
    return out.select("batch", "n", F.array_join("pixel_values", ",").alias("images"), F.array_join(hot, ",").alias("labels"))


@query(
    "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, list_transform(string_split(c_mktsegment, ''), lambda x: ascii(x)) AS ids FROM customer), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY pos // 16) AS most FROM o) "
    "SELECT pos // 16 AS batch, CAST(count(*) AS INTEGER) AS n, string_agg(c_custkey, ',' ORDER BY pos) AS images, string_agg(array_to_string(list_concat(ids, list_transform(range(0, most - len(ids)), lambda i: 0)), ' '), ',' ORDER BY pos) AS input_ids, true AS return_loss FROM m GROUP BY pos // 16"
)
def u11_contrastive_batches(spark, d):
    ids = F.transform(F.filter(F.split("c_mktsegment", ""), lambda x: x != ""), lambda x: F.ascii(x))
    source = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("image"), ids.alias("ids"))
    out = batches.contrastive_batches(source, ["c_custkey"], "ids", 16)
    return out.select("batch", "n", F.array_join("pixel_values", ",").alias("images"), F.array_join(F.transform("input_ids", lambda x: F.array_join(x, " ")), ",").alias("input_ids"), "return_loss")


@query(
    with_(PX) + ", o AS (SELECT p_partkey AS img, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT pos // 8 AS batch, CAST(count(DISTINCT img) AS INTEGER) AS n, "
    "md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY pos, r, c)) AS labels, array_to_string(list_transform(range(0, count(DISTINCT img)), lambda i: '20x23'), ',') AS sizes FROM o JOIN px USING (img) GROUP BY pos // 8"
)
def u8_segmentation_batches(spark, d):
    source = masks(spark, d).select("img", F.col("img").alias("image"), "mask", F.array("h", "w", F.lit(3)).alias("target_size"))
    out = batches.segmentation_batches(source, ["img"], 8, target_sizes=True)
    labels = F.md5(F.array_join(F.transform(F.flatten("labels"), lambda x: x.cast("string")), ","))
    return out.select("batch", "n", labels.alias("labels"), F.array_join(F.transform("target_sizes", lambda x: F.array_join(x, "x")), ",").alias("sizes"))


@query(
    with_(PX) + ", o AS (SELECT p_partkey AS img, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part), i AS (SELECT DISTINCT pos, k, CAST((k + img) % 4 AS INTEGER) AS class FROM o JOIN px USING (img) WHERE k <> 0) "
    "SELECT pos // 8 AS batch, CAST(pos % 8 AS INTEGER) AS place, string_agg(k, ',' ORDER BY k) AS ids, string_agg(class, ',' ORDER BY k) AS classes FROM i GROUP BY pos"
)
def u8_panoptic_batches(spark, d):
    classes = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.struct(k, ((k + F.col("img")) % 4).cast("int"))))
    out = batches.panoptic_batches(masks(spark, d).withColumn("image", F.col("img")).withColumn("classes", classes), ["img"], 8)
    each = out.select("batch", F.posexplode(F.arrays_zip("mask_labels", "class_labels")).alias("place", "z"))
    return each.select("batch", "place", F.array_join("z.mask_labels", ",").alias("ids"), F.array_join("z.class_labels", ",").alias("classes"))


@query(
    "WITH o AS (SELECT p_partkey AS img, p_size % 7 + 3 AS h, p_size % 5 + 4 AS w, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) "
    "SELECT pos // 8 AS batch, CAST(pos % 8 AS INTEGER) AS place, img, h, w, max(h) OVER (PARTITION BY pos // 8) AS to_h, max(w) OVER (PARTITION BY pos // 8) AS to_w, h * w AS area FROM o"
)
def u8_detection_batches(spark, d):
    sized = table(spark, d, "part").select(F.col("p_partkey").alias("img"), F.col("p_partkey").alias("image"), (F.col("p_size") % 7 + 3).alias("h"), (F.col("p_size") % 5 + 4).alias("w"))
    out = batches.detection_batches(sized.withColumn("labels", F.struct(F.col("img").alias("image_id"), (F.col("h") * F.col("w")).alias("area"))), ["img"], 8)
    each = out.select("batch", F.posexplode(F.arrays_zip("pixel_values", "pixel_mask", "labels")).alias("place", "z"))
    return each.select("batch", "place", F.col("z.pixel_values").alias("img"), "z.pixel_mask.h", "z.pixel_mask.w", "z.pixel_mask.to_h", "z.pixel_mask.to_w", "z.labels.area")


def _texts_sql(label_pad: str) -> str:
    return (
        "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, list_append(list_transform(string_split(c_mktsegment, ''), lambda x: ascii(x)), 2) AS ids FROM customer), "
        "m AS (SELECT *, max(len(ids)) OVER (PARTITION BY pos // 16) - len(ids) AS more FROM o), pad AS (SELECT *, list_transform(range(0, more), lambda i: 0) AS zeros FROM m) "
        "SELECT c_custkey, pos // 16 AS batch, CAST(pos % 16 AS INTEGER) AS place, array_to_string(ids || zeros, ',') AS input_ids, "
        f"array_to_string(list_transform(ids, lambda i: 1) || zeros, ',') AS attention_mask, array_to_string(ids || list_transform(zeros, lambda i: {label_pad}), ',') AS labels FROM pad"
    )


def _text_rows(spark, d, label_pad):
    ids = F.transform(F.filter(F.split("c_mktsegment", ""), lambda x: x != ""), lambda x: F.ascii(x))
    source = table(spark, d, "customer").select("c_custkey", ids.alias("ids"))
    out = batches.text_batches(source, ["c_custkey"], "ids", 16, pad=0, end=2, label_pad=label_pad)
    return out.select("c_custkey", "batch", "place", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(_texts_sql("0"))
def u10_text_batches(spark, d):
    return _text_rows(spark, d, None)


@query(_texts_sql("-100"))
def u10_text_batches_ignored_padding(spark, d):
    return _text_rows(spark, d, -100)


def _axis(name: str, to: int, source: int) -> str:
    at = f"greatest(0, least({source - 1}, (i + 0.5::DOUBLE) * {source} / {to} - 0.5::DOUBLE))"
    return f"{name}s AS (SELECT CAST(i AS INTEGER) AS t{name}, CAST(floor(v) AS INTEGER) AS {name}0, CAST(least(floor(v) + 1, {source - 1}) AS INTEGER) AS {name}1, v - floor(v) AS f{name} FROM (SELECT i, {at} AS v FROM unnest(range(0, {to})) a(i)))"


@query(
    with_(_axis("y", 9, 4), _axis("x", 7, 4)) + f"SELECT img, r, c, CAST((label + 3 * t) % 10 + 1 AS INTEGER) AS k FROM (SELECT vec_id AS img, label, t, ty AS r, tx AS c, {_blend(lambda r, c: f'CAST(embedding[t * 16 + {r} * 4 + {c} + 1] AS DOUBLE)')} AS v "
    "FROM embeddings, ys, xs, unnest(range(0, 4)) a(t)) QUALIFY row_number() OVER (PARTITION BY img, r, c ORDER BY v DESC, t) = 1"
)
def m6_prompted_masks(spark, d):
    texts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: captions.names_map(NAMES)[((F.col("label") + 3 * t) % 10 + 1).cast("int")])
    logits = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), texts.alias("texts"), F.col("embedding").alias("logits"), F.lit(4).alias("lh"), F.lit(4).alias("lw"), F.lit(9).alias("h"), F.lit(7).alias("w"))
    return dense.to_pixels(prompted.prompted_masks(logits, LABEL2ID))


def _beam_sql(beams: int, most: int, ngram: int) -> str:
    """The search unrolled, a few relations for each token: continuations (co), the best of them (ra), those that end (en), those that go on (li)."""
    logp = "v - m - ln(sum(exp(v - m)) OVER (PARTITION BY vec_id, a))"
    out = [
        "raw AS MATERIALIZED (SELECT vec_id, CAST(i // 8 AS INTEGER) AS a, CAST(i % 8 AS INTEGER) AS b, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(0, 64)) t(i))",
        "top AS MATERIALIZED (SELECT *, max(v) OVER (PARTITION BY vec_id, a) AS m FROM raw)",
        f"tr AS MATERIALIZED (SELECT vec_id, a, b, round(({logp}) * 16777216) / 16777216 AS lp FROM top)",
        "li1 AS MATERIALIZED (SELECT DISTINCT vec_id, CAST(0 AS BIGINT) AS beam, [0] AS toks, 0.0::DOUBLE AS s FROM tr)",
    ]
    ended = []
    for n in range(1, most):
        grams = ", ".join(f"toks[{i}:{i + ngram - 1}]" for i in range(1, n - ngram + 2))
        again = f"list_contains([{grams}], list_append(toks[{n - ngram + 2}:], b))" if grams else "false"
        allowed = f"NOT {again}" + (" AND b <> 1" if n < 3 else "")
        out.append(f"co{n} AS MATERIALIZED (SELECT l.vec_id, beam, toks, b, s + CASE WHEN list_contains(toks, b) AND lp < 0 THEN lp * 2.5 ELSE lp END AS s FROM li{n} l JOIN tr ON tr.vec_id = l.vec_id AND tr.a = toks[{n}] WHERE {allowed})")
        out.append(f"ra{n} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, beam, b) AS rk FROM co{n}) WHERE rk <= {2 * beams})")
        out.append(f"en{n} AS MATERIALIZED (SELECT vec_id, list_append(toks[2:], b) AS toks, s / power({n}, 1.5) AS s, {n} AS n, rk, true AS ended FROM ra{n} WHERE b = 1 AND rk <= {beams})")
        ended.append(f"SELECT * FROM en{n}")
        done = f"SELECT vec_id FROM ({' UNION ALL '.join(ended)}) GROUP BY vec_id HAVING count(*) >= {beams}"
        out.append(f"li{n + 1} AS MATERIALIZED (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY rk) - 1 AS beam, list_append(toks, b) AS toks, s FROM ra{n} WHERE b <> 1 AND vec_id NOT IN ({done}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rk) <= {beams})")
    ended.append(f"SELECT vec_id, toks[2:] AS toks, s / power({most - 1}, 1.5) AS s, {most} AS n, beam AS rk, false AS ended FROM li{most}")
    return with_(*out) + f"SELECT vec_id, array_to_string(toks, ' ') AS tokens, round(s, 6) AS score, ended FROM ({' UNION ALL '.join(ended)}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, n, rk) = 1"


@query(_beam_sql(4, 10, 4))
def m3_beam_search(spark, d):
    """The 64 numbers of each vector as logits of 8 tokens after each of 8."""
    given = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("m"))
    out = decoding.beam_search(given, "vec_id", ["m"], decoding.transition_scores("m", 8), 8, max_length=10)
    return out.select("vec_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), F.round("score", 6).alias("score"), "ended")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_id, event_type FROM events")
def a13_output_positions(spark, d):
    """The same outputs as rows with their offsets, for groups of any size."""
    return batches.numbered(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["ts", "event_id"], "user_id").drop("ts")


_PATH = "CASE WHEN doc_id % 3 = 0 THEN './img/' ELSE '.\\img\\' END || doc_id || '.png'"


@query(f"SELECT doc_id, replace('/data/set/' || substr({_PATH}, 2), '\\', '/') AS image FROM documents")
def s7_rebase_paths(spark, d):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("./img/")).otherwise(F.lit(".\\img\\")), F.col("doc_id").cast("string"), F.lit(".png"))
    return table(spark, d, "documents").select("doc_id", rows.rebase_path(path, "/data/set/train.parquet").alias("image"))


@query("SELECT doc_id, replace('/data/set/img/' || doc_id || '/data/set', '/data/set', '.') AS image FROM documents")
def s8_unbase_paths(spark, d):
    path = F.concat(F.lit("/data/set/img/"), F.col("doc_id").cast("string"), F.lit("/data/set"))
    return table(spark, d, "documents").select("doc_id", rows.unbase_path(path, "/data/set/train.parquet").alias("image"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS at FROM embeddings")
def t3_first_arg_max(spark, d):
    return table(spark, d, "embeddings").select("vec_id", maskstats.first_max(F.col("embedding")).alias("at"))


@query(with_(PX, FLIPPED) + "SELECT img, r, c, CASE WHEN k >= 7 THEN 0 ELSE k END AS k, 20 AS h, 23 AS w FROM fl")
def u1_segmentation_transform(spark, d):
    out = transforms.segmentation(pixels(spark, d), HEIGHT, WIDTH, 7, aug=True)
    return out.select("img", "r", "c", "k", F.col("target_size.h").alias("h"), F.col("target_size.w").alias("w"))


@query(with_(PX, DIM, AREA, FLIPPED, f"ca AS ({_caption_sql('en')})") + "SELECT fl.img, caption, string_agg(k, ',' ORDER BY r, c) AS mask FROM fl JOIN ca ON ca.img = fl.img GROUP BY fl.img, caption")
def u2_image_to_text_transform(spark, d):
    out = transforms.image_to_text(masks(spark, d), _captions(spark, d, "en"), HEIGHT, WIDTH, aug=True)
    return out.select("img", "caption", _listed("mask"))


SIZE = (31, 17)


def _byte_at(r: str, c: str) -> str:
    return f"(({r}) * 7 + ({c}) * 5 + ch * 31 + p_size * 3 + p_partkey * 11) % 256"


def _coin_sql(name: str) -> str:
    return _COIN.format(name).replace("img", "p_partkey")


#: Images brought to 31 x 17 and mirrored, as md5 of their bytes in hex: channels first, last, and last with blue first.
SHOWN = f"""{BETWEEN},
sh AS (SELECT p_partkey AS img, ch, CASE WHEN {_coin_sql("v")} THEN 30 - tr ELSE tr END AS r, CASE WHEN {_coin_sql("h")} THEN 16 - tc ELSE tc END AS c,
         printf('%02X', CAST(floor({_blend(_byte_at)} + 0.500001::DOUBLE) AS BIGINT)) AS v FROM part, ys, xs, unnest(range(0, 3)) e(ch)),
im AS (SELECT img, md5(string_agg(v, '' ORDER BY ch, r, c)) AS first, md5(string_agg(v, '' ORDER BY r, c, ch)) AS last, md5(string_agg(v, '' ORDER BY r, c, -ch)) AS blue FROM sh GROUP BY img)"""


def _moved_sql(source: str) -> str:
    """Masks of the relation ``source`` (img, r, c, k) brought to 31 x 17 by the nearest pixel and mirrored, as lists in a string."""
    return f"""mo AS (SELECT p_partkey AS img, CASE WHEN {_coin_sql("v")} THEN 30 - tr ELSE tr END AS r, CASE WHEN {_coin_sql("h")} THEN 16 - tc ELSE tc END AS c, coalesce(k, 0) AS k
  FROM part CROSS JOIN ys CROSS JOIN xs LEFT JOIN {source} s ON s.img = p_partkey AND s.r = tr * 20 // 31 AND s.c = tc * 23 // 17),
ma AS (SELECT img, string_agg(k, ',' ORDER BY r, c) AS mask FROM mo GROUP BY img)"""


def _md5():
    return F.md5(F.hex("image")).alias("image")


def _listed(name: str):
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


@query(with_(PX, SHOWN, "cl AS (SELECT img, r, c, CASE WHEN k >= 7 THEN 0 ELSE k END AS k FROM px)", _moved_sql("cl")) + "SELECT img, first AS image, mask, '31,17' AS target_size FROM im JOIN ma USING (img)")
def u1_segmentation_images(spark, d):
    both = images(spark, d).join(masks(spark, d).select("img", "mask").hint("merge"), "img")
    return transforms.segmentation_images(both, 7, True, SIZE).select("img", _md5(), _listed("mask"), _listed("target_size"))


@query(with_(SHOWN) + "SELECT img, last AS image, 'part ' || img AS caption FROM im")
def u2_image_to_text_images(spark, d):
    captioned = images(spark, d).withColumn("caption", F.concat(F.lit("part "), F.col("img").cast("string")))
    return transforms.image_to_text_images(captioned, True, SIZE).select("img", _md5(), "caption")


@query(with_(SHOWN) + "SELECT img, first AS image, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN i = img % 5 THEN 1 ELSE 0 END), '') AS hot FROM im")
def u3_multi_label_images(spark, d):
    labelled = images(spark, d).withColumn("labels", F.array((F.col("img") % 5).cast("int")))
    return transforms.multi_label_images(labelled, 4, True, size=SIZE).select("img", _md5(), F.array_join(F.col("labels").cast("array<string>"), "").alias("hot"))


@query(
    with_(SHOWN, "bo AS (SELECT *, x * 17 / 23::DOUBLE AS x1, y * 31 / 20::DOUBLE AS y1, w * 17 / 23::DOUBLE AS w1, h * 31 / 20::DOUBLE AS h1 FROM (SELECT p_partkey, p_partkey % 9 AS x, p_size % 8 AS y, 3 + p_size % 7 AS w, 2 + p_partkey % 6 AS h FROM part))")
    + f"SELECT img AS image_id, blue AS image, 1 + img % 4 AS category_id, w * h AS area, round(CASE WHEN {_coin_sql('h')} THEN 17 - x1 - w1 ELSE x1 END, 6) AS x, round(CASE WHEN {_coin_sql('v')} THEN 31 - y1 - h1 ELSE y1 END, 6) AS y, round(w1, 6) AS w, round(h1, 6) AS h FROM im JOIN bo ON p_partkey = img"
)
def u4_detection_images(spark, d):
    x, y, w, h = F.col("img") % 9, F.col("p_size") % 8, 3 + F.col("p_size") % 7, 2 + F.col("img") % 6
    sized = images(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("img"), "p_size"), "img")
    boxed = sized.select(F.col("img").alias("image_id"), "h", "w", "image", F.array(1 + F.col("img") % 4).alias("category_id"), F.array(w * h).alias("area"), F.array(F.array(x, y, w, h).cast("array<double>")).alias("bbox"))
    out = transforms.detection_images(boxed, True, SIZE, noise=0.0).select("image_id", _md5(), F.explode("annotations").alias("a"))
    return out.select("image_id", "image", "a.category_id", "a.area", *[F.round(F.get("a.bbox", F.lit(i)), 6).alias(n) for i, n in enumerate("xywh")])


@query(
    with_(RASTER, SHOWN, "cv AS (SELECT img, r, c, max(inst) AS k FROM hit WHERE n % 2 = 1 OR onit GROUP BY img, r, c)", _moved_sql("cv"), "ic AS (SELECT img, '0,' || string_agg(category_id + 1, ',' ORDER BY inst) AS classes FROM po GROUP BY img)")
    + "SELECT img, first AS image, mask, classes FROM im JOIN ma USING (img) JOIN ic USING (img)"
)
def u5_panoptic_images(spark, d):
    both = images(spark, d).join(polygons(spark, d), "img")
    out = transforms.panoptic_images(both, True, SIZE, noise=0.0)
    classes = F.array_join(F.transform(F.sequence(F.lit(0), F.size("instance_id_to_semantic_id") - 1), lambda i: F.element_at("instance_id_to_semantic_id", i).cast("string")), ",")
    return out.select("img", _md5(), _listed("mask"), classes.alias("classes"))


@query(
    with_(RASTER, SHOWN, f"cv AS ({_SEMANTIC.format('category_id IN (1, 3)')})", _moved_sql("cv"), "ic AS (SELECT img, count(DISTINCT category_id) AS classes FROM po WHERE category_id IN (1, 3) GROUP BY img)")
    + "SELECT img, first AS image, mask, classes FROM im JOIN ma USING (img) JOIN ic USING (img)"
)
def u6_semantic_images(spark, d):
    both = images(spark, d).join(polygons(spark, d), "img")
    out = transforms.semantic_images(both, True, [1, 3], SIZE, noise=0.0)
    return out.select("img", _md5(), _listed("mask"), F.size("instance_id_to_semantic_id").cast("long").alias("classes"))


@query(with_(RASTER) + "SELECT h.img, h.inst, category_id + 1 AS class, count(*) AS n FROM (SELECT img, r, c, max(inst) AS inst FROM hit WHERE n % 2 = 1 OR onit GROUP BY img, r, c) h JOIN po ON po.img = h.img AND po.inst = h.inst GROUP BY ALL")
def u5_panoptic_transform(spark, d):
    mask, classes = transforms.panoptic(polygons(spark, d), HEIGHT, WIDTH)
    return mask.groupBy("img", "inst").agg(F.count("*").alias("n")).join(classes, ["img", "inst"]).select("img", "inst", "class", "n")


@query(with_(RASTER) + _SEMANTIC.format("category_id IN (1, 3)"))
def u6_semantic_from_polygons(spark, d):
    return transforms.semantic_from_polygons(polygons(spark, d), HEIGHT, WIDTH, [1, 3])


def _stop_sql(delta: float) -> str:
    return f"""WITH RECURSIVE s AS (SELECT user_id, -value AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, score AS best, 0 AS counter, false AS stopped FROM s WHERE rn = 1
  UNION ALL SELECT f.user_id, s.rn, CASE WHEN s.score < f.best + {delta} THEN f.best ELSE s.score END, CASE WHEN s.score < f.best + {delta} THEN f.counter + 1 ELSE 0 END, f.stopped OR (s.score < f.best + {delta} AND f.counter + 1 >= 7)
  FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, best, counter, stopped FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"""


@query(_stop_sql(0.0))
def w1_early_stopping(spark, d):
    return rows.early_stopping(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query(_stop_sql(0.5))
def w1_early_stopping_delta(spark, d):
    return rows.early_stopping(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", delta=0.5)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """img, k, area, cell_name, box and caption of each class of each image."""
    px = _runs(spark, d)
    area = maskstats.area_ratio(px)
    cells = maskstats.nine_cell(px, HEIGHT, WIDTH).withColumn("cell_name", maskstats.cell_name(F.col("cell")))
    out = area.join(maskstats.bounding_box(px), ["img", "k"]).join(cells, ["img", "k"]).join(captions.id_captions(area, NAMES), "img")
    return maskstats.strict_lookup(out.withColumnRenamed("k", "label_id"), label_dim(spark, "qa"), "label_id").select("img", "label_id", "label_name", "area", "cell_name", "x", "y", "w", "h", "caption")
