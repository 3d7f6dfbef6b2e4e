"""Batches for training: rows numbered in a global order, grouped by so many, padded and stacked.

Numbers come from range partitions: each counts its rows in order, and the sizes of the
partitions before it are added, so that no task sees all rows or all rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored


def numbered(rows: DataFrame, order: Sequence[str], group: str | None = None, name: str = "position") -> DataFrame:
    """``rows`` with ``name``: the place from 0 in the order of ``order`` (nulls first), within ``group`` if there is one.

    Rows that agree in all of ``order`` come in any order. A group of any size is dealt
    over the range partitions. A null group counts as one like any other; an empty table
    gives no rows. The columns ``_part`` and ``_i`` must not be among the rows'.
    """
    keys = [*([group] if group else []), *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    i = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.withColumns({"_part": F.spark_partition_id(), "_i": i}), "numbered")
    by = [F.col(group).alias("_group")] if group else [F.lit(0).alias("_group")]
    parts = placed.groupBy(*by, F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = W.partitionBy("_group").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition at most
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if group:
        same = (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group"))
    else:
        same, parts = F.col("_part") == F.col("_in"), F.broadcast(parts)  # as many rows as partitions
    return placed.join(parts, same).withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).drop("_group", "_in", "_first", "_before", "_part", "_i")


def batched(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``batch`` and ``place``: ``size`` rows to a batch in a global order, the last batch what is left."""
    at = numbered(rows, order, name="_position")
    return at.withColumn("batch", F.expr(f"_position DIV {int(size)}")).withColumn("place", (F.col("_position") % size).cast("int")).drop("_position")


def stacked(batches: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row for each batch: batch, n and a list in order for each of ``columns``; a list is as long as the batch."""
    whole = F.array_sort(F.collect_list(F.struct("place", *[c.alias(n) for n, c in columns.items()])))
    return batches.groupBy("batch").agg(whole.alias("_w")).select("batch", F.size("_w").alias("n"), *[F.col(f"_w.{n}").alias(n) for n in columns])


def classification_batches(rows: DataFrame, order: Sequence[str], size: int, need_labels: bool = True) -> DataFrame:
    """batch, n, pixel_values[, labels] of rows (image, labels): multi-hot labels as floats."""
    columns = {"pixel_values": F.col("image")}
    if need_labels:
        columns["labels"] = F.transform("labels", lambda x: x.cast("float"))
    return stacked(batched(rows, order, size), columns)


def contrastive_batches(rows: DataFrame, order: Sequence[str], ids: str, size: int, pad: int = 0) -> DataFrame:
    """batch, n, pixel_values, input_ids, attention_mask, return_loss of rows (image, token ids): pairs whose loss is taken within their batch."""
    texts = text_batches(rows, order, ids, size, pad, need_labels=False)
    out = stacked(texts, {"pixel_values": F.col("image"), "input_ids": F.col("input_ids"), "attention_mask": F.col("attention_mask")})
    return out.withColumn("return_loss", F.lit(True))


def segmentation_batches(rows: DataFrame, order: Sequence[str], size: int, target_sizes: bool = False) -> DataFrame:
    """batch, n, pixel_values, labels[, target_sizes] of rows (image, mask[, target_size: height, width, ...])."""
    columns = {"pixel_values": F.col("image"), "labels": F.transform("mask", lambda x: x.cast("short"))}
    if target_sizes:
        columns["target_sizes"] = F.slice("target_size", 1, 2)
    return stacked(batched(rows, order, size), columns)


def panoptic_batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """batch, n, pixel_values, mask_labels, class_labels: the ids that a row's instance mask has, in order, through the row's own map to classes.

    ``classes`` is the row's map from instance to class; an instance that it lacks has no class label.
    """
    own = F.array_sort(F.array_distinct("mask"))
    both = F.filter(F.transform(own, lambda k: F.struct(k.alias("id"), F.col("classes")[k.cast("int")].alias("class"))), lambda x: x["class"].isNotNull())
    return stacked(batched(rows, order, size), {"pixel_values": F.col("image"), "mask_labels": F.transform(both, lambda x: x["id"]), "class_labels": F.transform(both, lambda x: x["class"])})


def detection_batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """batch, n, pixel_values, pixel_mask, labels of rows (image, h, w, labels): images stay as they are, ``pixel_mask`` has each one's height and width within the largest of its batch."""
    at = batched(rows, order, size)
    own = W.partitionBy("batch")  # a batch's rows
    at = at.withColumn("_most", F.struct(F.max("h").over(own).alias("h"), F.max("w").over(own).alias("w")))
    mask = F.struct(F.col("h").alias("h"), F.col("w").alias("w"), F.col("_most.h").alias("to_h"), F.col("_most.w").alias("to_w"))
    return stacked(at, {"pixel_values": F.col("image"), "pixel_mask": mask, "labels": F.col("labels")})


def text_batches(rows: DataFrame, order: Sequence[str], ids: str, size: int, pad: int = 0, end: int | None = None, label_pad: int | None = None, need_labels: bool = True) -> DataFrame:
    """``rows`` with batch, place, input_ids, attention_mask and labels: ids padded to the longest of their batch.

    With ``end``, that id follows each text's. Labels repeat the input ids, padding
    included; ``label_pad`` (-100, say) takes the padding's place in them. Null ids count
    as none. For generation, ``need_labels`` is off.
    """
    own = F.coalesce(F.col(ids), F.slice(F.array(F.lit(0)), 1, 0))
    own = F.concat(own, F.array(F.lit(end))) if end is not None else own
    at = batched(rows, order, size).withColumn("_own", own.cast("array<int>"))
    at = at.withColumn("_most", F.max(F.size("_own")).over(W.partitionBy("batch")))  # a batch's rows
    padded = lambda x: F.concat("_own", F.array_repeat(F.lit(x), F.col("_most") - F.size("_own")))
    ones = F.concat(F.array_repeat(F.lit(1), F.size("_own")), F.array_repeat(F.lit(0), F.col("_most") - F.size("_own")))
    out = at.withColumn("input_ids", padded(pad)).withColumn("attention_mask", ones)
    if need_labels:
        out = out.withColumn("labels", F.col("input_ids") if label_pad is None else padded(label_pad))
    return out.drop("_own", "_most")
