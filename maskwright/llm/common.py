"""Helpers the corpus operators share: shared-folder tables, partition counts, Arrow slicing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker holds as Python strings at once.
TEXT_SLICE = 256
#: Bytes of a long text that are cut into words at once.
TEXT_PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of this process; on a
    cluster there is none that executors could see, so this raises.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="maskwright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once all that was computed from them is stored itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(df: DataFrame, *extra: Column) -> DataFrame:
    """``df`` as one column ``row``, beside ``extra``: no name of its columns can clash with another."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *extra)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``whole_rows`` packed."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def buckets_for(rows: int, groups: int = 1) -> int:
    """Buckets that keep one (group, bucket) near 100,000 rows, 64 at least."""
    return max(64, rows // (100_000 * groups))


def bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """``df`` with ``_bucket``, dealt round robin and stored, so that a later job finds the same rows in the same buckets."""
    return stored(df.withColumn("_bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")), name)


def text_parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a megabyte, cut at white space, so that few of its words are Python objects at once."""
    start = 0
    while len(text) - start > TEXT_PART:
        gap = _GAP.search(text, start + TEXT_PART)
        if not gap:
            break
        yield text[start : gap.end()]
        start = gap.end()
    yield text[start:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_SLICE) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that few long texts are Python strings at the same time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
