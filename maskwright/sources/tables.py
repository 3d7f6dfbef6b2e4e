"""Readers, and the image fixtures that both engines derive from the same tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 20, 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Compact rows that each grow into much work: dealt out where a small file would make fewer tasks than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _value(r, c, key, size):
    v = F.pmod((r / F.lit(4)).cast("int") * 3 + (c / F.lit(5)).cast("int") * 5 + key * 7 + size, F.lit(17)).cast("int")
    return F.when(v < 11, v).otherwise(F.lit(0))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, r, c, k: one 20 x 23 class mask for each part."""
    at = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("img"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT * WIDTH - 1))).alias("i"))
    at = at.select("img", "p_size", F.expr(f"CAST(i DIV {WIDTH} AS INT)").alias("r"), (F.col("i") % WIDTH).alias("c"))
    return at.select("img", "r", "c", _value(F.col("r"), F.col("c"), F.col("img"), F.col("p_size")).alias("k"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, h, w, mask: the same masks as dense arrays, row by row."""
    r, c = np.divmod(np.arange(HEIGHT * WIDTH), WIDTH)
    place = r // 4 * 3 + c // 5 * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns)
            v = (place + (key * 7 + size)[:, None]) % 17
            v[(v >= 11) | (np.asarray(batch.column(0).is_null()) | np.asarray(batch.column(1).is_null()))[:, None]] = 0
            n = len(v)
            sides = [pa.array(np.full(n, x), pa.int32()) for x in (HEIGHT, WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides, pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(place), pa.array(v.astype(np.int16).ravel()))], names=["img", "h", "w", "mask"])

    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return dealt(part).mapInArrow(run, f"img {part.schema['p_partkey'].dataType.simpleString()}, h int, w int, mask array<short>")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, h, w, image: 20 x 23 pixels of three channels for each part, as bytes."""
    r, c, channel = np.indices((HEIGHT, WIDTH, 3)).reshape(3, -1)
    place = r * 7 + c * 5 + channel * 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns)
            long = len(place) * ~(np.asarray(batch.column(0).is_null()) | np.asarray(batch.column(1).is_null()))  # no byte without a key and a size
            v = (((key * 11 + size * 3)[:, None] + place) % 256).astype(np.uint8)[long > 0]
            ends = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
            sides = [pa.array(np.full(len(key), x), pa.int32()) for x in (HEIGHT, WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides, pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v))])], names=["img", "h", "w", "image"])

    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return dealt(part).mapInArrow(run, f"img {part.schema['p_partkey'].dataType.simpleString()}, h int, w int, image binary")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, points (flat x, y lists), category_id: three quadrilaterals for each part."""
    key, size = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")

    def quad(j: int):
        x, y = (key * 3 + 7 * j) % 12, (size + 5 * j) % 10
        w, h = 4 + (key + j) % 8, 4 + (size + j) % 6
        return F.array(x, y, x + w, y + key % 3, x + w - 1, y + h, x + 1, y + h - 1)

    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("img"), F.array(*map(quad, range(3))).alias("points"), F.array(*[(key + j) % 4 for j in range(3)]).alias("category_id"))


def labels_of(configs: DataFrame) -> DataFrame:
    """label_id, label_name from JSON configurations in column ``value`` (their ``id2label`` objects)."""
    names = F.from_json(F.get_json_object("value", "$.id2label"), "map<string,string>")
    return configs.select(F.explode(names).alias("label_id", "label_name")).select(F.col("label_id").cast("int").alias("label_id"), "label_name")


def model_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a model's JSON configuration file, or of all files below a folder."""
    return labels_of(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, length of the files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), "length")
