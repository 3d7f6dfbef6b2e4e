"""Row-level operators: paths, sentinels, rounding, lookups, labels, text augmentation, metrics."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import MARKS
from .batches import numbered
from .maskstats import if_small


def rebase_path(path: Column, dataset_path: str) -> Column:
    """A leading dot becomes the dataset's folder and a slash; back slashes become slashes."""
    base = posixpath.dirname(dataset_path) + "/"
    return F.replace(F.when(path.startswith("."), F.concat(F.lit(base), F.substring(path, 2, 1 << 30))).otherwise(path), F.lit("\\"), F.lit("/"))


def unbase_path(path: Column, dataset_path: str) -> Column:
    """Every occurrence of the dataset's folder becomes a dot; an empty folder is refused."""
    base = posixpath.dirname(dataset_path)
    if not base:
        raise ValueError("the dataset path has no folder")
    return F.replace(path, F.lit(base), F.lit("."))


def drop_null_rows(rows: DataFrame) -> DataFrame:
    return rows.na.drop("any")


def replace_sentinel(labels: Column, pad: int, sentinel: int = -100) -> Column:
    return F.transform(labels, lambda x: F.when(x == sentinel, F.lit(pad)).otherwise(x))


def round_values(rows: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Numbers or lists of numbers to ``n`` decimals, ties to even; other types raise."""
    out = {}
    for c in columns:
        kind = rows.schema[c].dataType.simpleString()
        if kind.startswith("array<") and kind[6:-1] in ("double", "float", "int", "bigint"):
            out[c] = F.transform(F.col(c), lambda x: F.bround(x, n))
        elif kind in ("double", "float", "int", "bigint"):
            out[c] = F.bround(F.col(c), n)
        else:
            raise TypeError(f"{c} is a {kind}, not a number or a list of numbers")
    return rows.withColumns(out)


def random_rows(rows: DataFrame, n: int, key: str, seed: str = "0") -> DataFrame:
    """``n`` rows in an order that looks random but depends on ``key`` and ``seed`` alone."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def pair_up(flat: Column, swap: bool = False) -> Column:
    """[x, y, ...] to points (x, y), or with x and y exchanged."""
    at = lambda i: (F.get(flat, 2 * i), F.get(flat, 2 * i + 1))[:: -1 if swap else 1]
    last = F.floor(F.size(flat) / 2).cast("int") - 1
    points = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(at(i)[0].alias("x"), at(i)[1].alias("y")))
    return F.when(last < 0, F.slice(points, 1, 0)).otherwise(points)


def keep_categories(rows: DataFrame, keep: Sequence[int]) -> DataFrame:
    """Parallel ``points`` and ``category_id`` lists with the kept categories alone; rows left empty go."""
    wanted = F.array(*map(F.lit, keep))
    both = F.filter(F.arrays_zip("points", "category_id"), lambda x: F.array_contains(wanted, x["category_id"]))
    out = rows.withColumn("_z", both).filter(F.size("_z") > 0)
    return out.withColumn("points", F.transform("_z", lambda x: x["points"])).withColumn("category_id", F.transform("_z", lambda x: x["category_id"])).drop("_z")


def zip_shortest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each position of parallel lists, up to the shortest."""
    n = F.least(*map(F.size, columns))
    cut = rows.withColumns({c: F.slice(F.col(c), F.lit(1), n) for c in columns})
    rest = [c for c in rows.columns if c not in columns]
    return cut.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "z")).select(*rest, "pos", *[F.col(f"z.{c}") for c in columns])


def inner_lookup(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a dimension; keys that it lacks are skipped."""
    return rows.join(if_small(dim), key)


def overlay(base: DataFrame, patch: DataFrame, key: str, value: str, trim: str = "") -> DataFrame:
    """``base`` with the values that ``patch`` has for its keys; keys of ``patch`` alone are left out. ``trim`` is cut from the patch's keys."""
    new = patch.select(F.replace(F.col(key), F.lit(trim), F.lit("")).alias(key) if trim else F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_there"))
    return base.join(new, key, "left").withColumn(value, F.when(F.col("_there"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_there")


def invert_map(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """value -> key; of keys with one value the last by ``order`` wins."""
    return rows.groupBy(value).agg(F.max_by(key, order).alias(key))


def segments_to_map(segments: Column) -> Column:
    """[{id, label_id}] to a map; of equal ids the last wins."""
    last = F.filter(segments, lambda x, i: ~F.exists(F.slice(segments, i + 2, F.greatest(F.size(segments) - i - 1, F.lit(0))), lambda y: y["id"] == x["id"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], x["label_id"])))


def newest(files: DataFrame, prefix: str, suffixes: Sequence[str] = (".pt", ".pth")) -> DataFrame:
    """path, modified, length of the checkpoint to load, from (path, modified, length) of files in folders.

    Of the folders whose path begins with ``prefix`` the newest one counts (by its
    newest file; ties: the greater path), and of its files with one of the suffixes, in
    just that spelling, the last by name. An empty file raises.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    inside = files.withColumn("folder", folder).filter(F.col("folder").startswith(prefix))
    last = inside.agg(F.max(F.struct("modified", "folder")).alias("b")).select(F.col("b.folder").alias("folder"))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    best = inside.join(last, "folder").filter(ends).agg(F.max(F.struct("path", "modified", "length")).alias("b")).select("b.path", "b.modified", "b.length").filter("path IS NOT NULL")
    return best.withColumn("length", F.when(F.col("length") == 0, F.raise_error(F.lit("empty checkpoint")).cast("long")).otherwise(F.col("length")))


def multi_hot(ids: Column, num_labels: int, reduce_labels: bool = True) -> Column:
    """[0, 1, ...] of length ``num_labels``. Reduced: ids count from 1, and 0 and below are dropped. Else an id out of range raises."""
    shift = 1 if reduce_labels else 0
    hot = F.transform(F.sequence(F.lit(shift), F.lit(num_labels - 1 + shift)), lambda i: F.array_contains(ids, i).cast("int"))
    wrong = F.exists(ids, lambda x: (x > num_labels - 1 + shift) | (F.lit(not reduce_labels) & (x < 0)))
    return F.when(wrong, F.raise_error(F.lit("label id out of range")).cast("array<int>")).otherwise(hot)


def arg_max_label(logits: Column, ids: Sequence[int]) -> Column:
    """The label id of the greatest logit; ties to the first."""
    at = F.array_position(logits, F.array_max(logits)).cast("int") - 1
    return F.get(F.array(*map(F.lit, ids)), at)


def masked_mean(rows: DataFrame, group: str, vector: str, mask: str) -> DataFrame:
    """group, dim, mean: sum of masked components over the mask's sum (1e-9 at least)."""
    at = rows.select(group, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("dim", "x"))
    return at.groupBy(group, "dim").agg((F.sum(F.col("x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("mean"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside of a lambda over many elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(vector: Column) -> Column:
    """Weights above 0 that sum to 1."""
    exps = lambda top: F.transform(vector, lambda x: F.exp((x - top).cast("double")))
    weights = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total))
    return let(let(F.array_max(vector), exps), weights)


def rank_of(*parts: Column | str) -> Column:
    """A pseudo-random number below 2^32 that depends on the given values alone."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def insert_marks(text: Column, key: Column, ratio: float = 0.3) -> Column:
    """Punctuation before some words of a text split at single spaces: between 1 and ``ratio`` x words + 1 of them, drawn by hashes of the key and the place."""
    mark = lambda i: F.get(F.array(*map(F.lit, MARKS)), F.pmod(rank_of(key, i, F.lit("m")), F.lit(len(MARKS))).cast("int"))

    def marked(words: Column) -> Column:
        draws = F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))).alias("rank"), i.alias("i"), w.alias("w")))
        count = F.pmod(rank_of(key, F.lit("q")), F.floor(F.lit(ratio) * F.size(words) + 1)) + 1
        word = lambda q: lambda x, place: F.struct(x["i"].alias("i"), F.when(place < q, F.concat(mark(x["i"]), F.lit(" "), x["w"])).otherwise(x["w"]).alias("w"))
        return F.array_sort(let(count, lambda q: F.transform(F.array_sort(draws), word(q))))

    return F.array_join(F.transform(let(F.split(text, " ", -1), marked), lambda x: x["w"]), " ")


def drop_share(rows: DataFrame, label: str, key: str, share: float = 0.9, value: int = 0) -> DataFrame:
    """Exactly ``round(share x n)`` of the n rows whose label is ``value`` go, by the order of a hash of the key.

    Those rows are numbered over range partitions of the hash, so that no task orders all of them.
    """
    hit = F.coalesce(F.col(label) == value, F.lit(False))
    at = numbered(rows.filter(hit).withColumn("_h", F.md5(F.col(key).cast("string"))), ["_h", key], name="_at")
    gone = at.agg(F.bround(F.count("*") * share).alias("_gone"))  # one row
    kept = at.join(F.broadcast(gone), F.col("_at") >= F.col("_gone"))
    return rows.filter(~hit).unionByName(kept.select(*rows.columns))


def augment(rows: DataFrame, text: str, key: str, ratio: float = 0.3, label: str | None = None, share: float = 0.9) -> DataFrame:
    """Rows without nulls, some of label 0 dropped if ``label`` is given, marks inserted; a ratio of 0 changes nothing."""
    if ratio == 0:
        return rows
    rows = drop_null_rows(rows)
    if label:
        rows = drop_share(rows, label, key, share)
    return drop_null_rows(rows.withColumn(text, insert_marks(F.col(text), F.col(key), ratio)))


def coco_annotations(image_id: Column, categories: Column, areas: Column, boxes: Column) -> Column:
    """A list of {image_id, category_id, isCrowd, area, bbox} from parallel lists."""
    return F.transform(F.arrays_zip(categories.alias("c"), areas.alias("a"), boxes.alias("b")), lambda x: F.struct(image_id.alias("image_id"), x["c"].alias("category_id"), F.lit(0).alias("isCrowd"), x["a"].alias("area"), x["b"].alias("bbox")))


def _fold(patience: int, delta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, counter, stopped, begun = None, None, 0, False, False
        for batch in batches:
            done, schema = [], batch.schema
            for key, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or key != now:
                    if begun:
                        done.append((now, best, counter, stopped))
                    now, best, counter, stopped, begun = key, None, 0, False, True
                score = None if loss is None else -loss
                if best is not None and score is not None and score < best + delta:
                    counter += 1
                    stopped = stopped or counter >= patience
                else:
                    best, counter = score, 0
            yield _folded(done, schema)
        if begun:
            yield _folded([(now, best, counter, stopped)], schema)

    return run


def _folded(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema.field(0).type, pa.float64(), pa.int32(), pa.bool_()), strict=True)], names=["grp", "best", "counter", "stopped"])


def early_stopping(rows: DataFrame, group: str, order: Sequence[str], loss: str, patience: int = 7, delta: float = 0.0) -> DataFrame:
    """group, best, counter, stopped after a fold over each group's losses in order.

    Rows sorted by group and order stream through the tasks; a task keeps the state of
    one series alone, so a series may be of any length. A null loss starts afresh.
    """
    kind = rows.schema[group].dataType.simpleString()
    series = rows.select(F.col(group).alias("grp"), F.col(loss).cast("double").alias("loss"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ranked = series.repartition("grp").sortWithinPartitions("grp", *[f"o{i}" for i in range(len(order))]).select("grp", "loss")
    return ranked.mapInArrow(_fold(patience, delta), f"grp {kind}, best double, counter int, stopped boolean").withColumnRenamed("grp", group)


def mean_loss(rows: DataFrame, group: str, loss: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(loss).alias("mean_loss"))


def weighted_loss(rows: DataFrame, group: str, loss: str, size: Column) -> DataFrame:
    """Loss weighted by batch sizes."""
    return rows.groupBy(group).agg((F.sum(F.col(loss) * size) / F.sum(size)).alias("weighted_loss"))


def concat_outputs(rows: DataFrame, group: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Batch outputs of each group laid end to end in order, one list for each column."""
    whole = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return rows.groupBy(group).agg(whole.alias("_w")).select(group, *[F.col(f"_w.{v}").alias(v) for v in values])


def flip(pixels: DataFrame, height: int, width: int, horizontal: Column, vertical: Column) -> DataFrame:
    """Pixels mirrored where the coins (columns of the image) say so."""
    return pixels.withColumn("c", F.when(horizontal, width - 1 - F.col("c")).otherwise(F.col("c"))).withColumn("r", F.when(vertical, height - 1 - F.col("r")).otherwise(F.col("r")))


def coin(key: Column, name: str, p: float = 0.5) -> Column:
    return rank_of(key, F.lit(name)) < int(p * 2**32)


def channels_first(image: Column, height: int, width: int, channels: int = 3, reverse: bool = False) -> Column:
    """A flat (h, w, channel) list as (channel, h, w), with the channels reversed for BGR."""
    size = height * width
    which = lambda i: F.floor(i / F.lit(size)).cast("int")
    from_channel = lambda i: (channels - 1 - which(i)) if reverse else which(i)
    return F.transform(F.sequence(F.lit(0), F.lit(size * channels - 1)), lambda i: F.get(image, (i % size) * channels + from_channel(i)))


def gaussian_noise(values: Column, key: Column, seed: int, sigma: float = 1.0) -> Column:
    """Noise by the Box-Muller rule from hashes of the row's key, the place and the seed."""
    unit = lambda i, s: (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(s)), F.lit(1 << 31)).cast("double") + 0.5) / float(1 << 31)
    return F.transform(values, lambda x, i: x + F.lit(sigma) * F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * F.pi() * unit(i, 2)))
