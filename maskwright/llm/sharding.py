"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

Every leaf (shard) of a region / rack / shard tree gets one exponential draw per
key, ``-ln(u) / weight`` with ``u`` from ``xxhash64(key, shard)``. A rack's draw
is the least of its shards' and a region's the least of its racks', so an inner
node's draw is again exponential with the summed weight below it. A row descends
to the region with the least draw, in it to the rack with the least, in it to
the shard. A leaf whose weight changes alters only its own draws, hence only the
draws of its rack and region: rows move between that leaf and the others, never
between two leaves that keep their weights, and a leaf that is new only receives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, buckets_for


def topology(shards: int, regions: int = 4, racks: int = 2) -> list[list[list[int]]]:
    """region -> rack -> shards. The place of shard ``i`` depends on ``i`` alone, so a grown tree keeps the old places."""
    tree: list[list[list[int]]] = [[[] for _ in range(racks)] for _ in range(regions)]
    for i in range(shards):
        tree[i % regions][i // regions % racks].append(i)
    return [[rack for rack in region if rack] for region in tree if any(region)]


def draws(key: Column, weights: Sequence[float]) -> Column:
    """array<double>: the key's draw at each leaf; a leaf of weight 0 never wins."""
    unit = lambda h: (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda i: F.when(F.get(weight, i) > 0, -F.ln(unit(F.xxhash64(key, i))) / F.get(weight, i)).otherwise(F.lit(float("inf"))),
    )


def _least(nodes: Sequence[Column]) -> Column:
    return F.array_min(F.array(*nodes))


def descend(draw: Column, tree: list[list[list[int]]]) -> Column:
    """The shard reached from the root: at each level the child with the least draw (ties: the first child)."""
    at = lambda i: F.get(draw, F.lit(i))
    rack_draw = [[_least([at(i) for i in rack]) for rack in region] for region in tree]
    region_draw = [_least(racks) for racks in rack_draw]

    def first(children: Sequence[Column], draw_of: Sequence[Column]) -> Column:
        best, out = _least(draw_of), children[-1]
        for child, d in reversed(list(zip(children[:-1], draw_of[:-1], strict=True))):
            out = F.when(d == best, child).otherwise(out)
        return out

    in_rack = lambda rack: first([F.lit(i) for i in rack], [at(i) for i in rack])
    in_region = lambda r: first([in_rack(rack) for rack in tree[r]], rack_draw[r])
    return first([in_region(r) for r in range(len(tree))], region_draw).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", regions: int = 4, racks: int = 2) -> DataFrame:
    """``df`` with column ``out``: the shard of each row, decided by ``key`` and the weights. A null key is a key of its own."""
    d = draws(F.col(key), weights)
    return df.withColumn("_draw", d).withColumn(out, descend(F.col("_draw"), topology(len(weights), regions, racks))).drop("_draw")


def slots(df: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """``df`` with ``out``: row numbers, gapless from 0 in each shard.

    Rows are first dealt round robin into buckets, so that neither a large shard
    nor a repeated key numbers its rows in one task: a row's slot is its number in
    (shard, bucket) plus the sizes of the shard's earlier buckets.
    """
    dealt = bucketed(df, buckets_for(df.count(), 40), "slots")
    sizes = dealt.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy("_bucket"))
    return dealt.withColumn("_number", number).join(sizes, [shard, "_bucket"]).withColumn(out, (F.col("_number") - 1 + F.col("_before")).cast("long")).drop("_bucket", "_number", "_before")


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """All documents dealt to ``shards`` equal shards under the law ``key``.

    Null text has no bytes (size 16, CRC of the empty text); an empty table gives
    an empty result; repeated rows share a shard and get slots of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("law", F.lit("key")).withColumn("_draw", draws(F.col("doc_id"), [1.0] * (shards + 1)))
    rows = rows.withColumn("shard", descend(F.col("_draw"), topology(shards))).withColumn("grown_shard", descend(F.col("_draw"), topology(shards + 1))).drop("_draw")
    return slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
