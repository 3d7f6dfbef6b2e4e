"""Polygons as shapefiles: a Spark data source that writes .shp, .shx and .dbf, and a reader.

    spark.dataSource.register(ShapefileSource)
    polygons.write.format("shapefile").mode("append").save(folder)
    read_shapefiles(spark, folder)

Each task writes files of its own below ``_temporary``, several where rows are many; what
the successful attempts wrote is moved into the folder when all are done, and what failed
ones left is deleted. Rows have ``points``, a flat list x, y, ..., and whole numbers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: from the published descriptions of the formats
FILE_CODE, VERSION, POLYGON, DIGITS = 9994, 1000, 5, 20
#: Bytes of a .shp after which a task begins the next file.
FILE_BYTES = 64 << 20


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path)


def _header(size: int, box: tuple[float, float, float, float]) -> bytes:
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i4d4d", VERSION, POLYGON, *box, 0, 0, 0, 0)


def _twice_area(x: list[float], y: list[float]) -> float:
    return sum(x[i] * y[i - 1] - x[i - 1] * y[i] for i in range(len(x)))


@dataclass
class Shapes:
    """Records of one file in the three formats."""

    names: list[str]
    shp: list[bytes] = field(default_factory=list)
    shx: list[bytes] = field(default_factory=list)
    dbf: list[bytes] = field(default_factory=list)
    size: int = 100
    box: tuple[float, float, float, float] | None = None

    def add(self, points: list[float], values: list[int | None]) -> None:
        """A polygon of one ring: closed, and turned clockwise as outer rings are."""
        x, y = [float(v) for v in points[0::2]], [float(v) for v in points[1::2]]
        if len(x) != len(y) or len(x) < 3:
            raise ValueError("a polygon needs three points of two numbers at least")
        if _twice_area(x, y) < 0:
            x, y = x[::-1], y[::-1]
        if (x[0], y[0]) != (x[-1], y[-1]):
            x, y = [*x, x[0]], [*y, y[0]]
        box = min(x), min(y), max(x), max(y)
        content = struct.pack("<i4d3i", POLYGON, *box, 1, len(x), 0) + struct.pack(f"<{2 * len(x)}d", *(v for p in zip(x, y, strict=True) for v in p))
        place = struct.pack(">2i", self.size // 2, len(content) // 2)
        self.shx.append(place)
        self.shp.append(struct.pack(">2i", len(self.shx), len(content) // 2) + content)
        self.size += 8 + len(content)
        self.dbf.append(b" " + b"".join(f"{'' if v is None else int(v):>{DIGITS}}".encode() for v in values))
        self.box = box if self.box is None else (*map(min, self.box[:2], box[:2]), *map(max, self.box[2:], box[2:]))

    def files(self) -> dict[str, bytes]:
        box, fields = self.box or (0.0, 0.0, 0.0, 0.0), b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"N", DIGITS, 0) for n in self.names)
        table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(self.dbf), 33 + len(fields), 1 + DIGITS * len(self.names)) + fields + b"\r"
        return {"shp": _header(self.size, box) + b"".join(self.shp), "shx": _header(100 + 8 * len(self.shx), box) + b"".join(self.shx), "dbf": table + b"".join(self.dbf) + b"\x1a"}


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], file_bytes: int) -> None:
        self.path, self.names, self.file_bytes = path.rstrip("/"), names, file_bytes
        self.attempts = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, folder = file_system(self.attempts)
        store.create_dir(folder, recursive=True)
        made, now = [], Shapes([n for n in self.names if n != "points"])

        def flush() -> None:
            stem = f"part-{uuid.uuid4().hex}"
            for kind, data in now.files().items():
                with store.open_output_stream(f"{folder}/{stem}.{kind}") as out:
                    out.write(data)
                made.append(f"{stem}.{kind}")

        for row in rows:
            now.add(row["points"], [row[n] for n in now.names])
            if now.size >= self.file_bytes:
                flush()
                now = Shapes(now.names)
        if now.shp:
            flush()
        return Written(made)

    def commit(self, messages: list[Written]) -> None:
        store, folder = file_system(self.path)
        _, attempts = file_system(self.attempts)
        store.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{attempts}/{name}", f"{folder}/{name}")
        self.abort(messages)
        with store.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written]) -> None:
        store, attempts = file_system(self.attempts)
        if store.get_file_info(attempts).type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(attempts)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("shapefiles are written into a new folder or appended to one")
        return _Writer(self.options["path"], schema.fieldNames(), int(self.options.get("fileBytes", FILE_BYTES)))


def polygons_of(shp: bytes) -> Iterator[list[float]]:
    """Points of each record's first ring, without the closing one."""
    if struct.unpack(">i", shp[:4])[0] != FILE_CODE or struct.unpack("<2i", shp[28:36]) != (VERSION, POLYGON):
        raise ValueError("not a shapefile of polygons")
    at = 100
    while at < len(shp):
        _, words = struct.unpack(">2i", shp[at : at + 8])
        parts, points = struct.unpack("<2i", shp[at + 44 : at + 52])
        starts = struct.unpack(f"<{parts}i", shp[at + 52 : at + 52 + 4 * parts])
        first = at + 52 + 4 * parts
        end = starts[1] if parts > 1 else points
        yield list(struct.unpack(f"<{2 * end}d", shp[first : first + 16 * end])[:-2])
        at += 8 + 2 * words


def attributes_of(dbf: bytes) -> tuple[list[str], Iterator[list[int | None]]]:
    rows, head, width = struct.unpack("<IHH", dbf[4:12])
    names = [dbf[i : i + 11].split(b"\0")[0].decode() for i in range(32, head - 1, 32)]
    sizes = [dbf[i + 16] for i in range(32, head - 1, 32)]

    def values() -> Iterator[list[int | None]]:
        for r in range(rows):
            at, out = head + r * width + 1, []
            for size in sizes:
                text = dbf[at : at + size].strip()
                out.append(int(text) if text else None)
                at += size
            yield out

    return names, values()


def _read(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known, values = attributes_of(dbf)
                at = [known.index(n[:10]) for n in names]
                points, rows = list(polygons_of(shp)), list(values)
                yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in at], pa.array(points, pa.list_(pa.float64()))], names=[*names, "points"])

    return run


def read_shapefiles(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """names ..., points of the polygons in a folder; a task reads whole files, which the writer keeps small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder).select(F.regexp_extract("path", r"^(.*)\.(\w+)$", 1).alias("stem"), F.regexp_extract("path", r"^(.*)\.(\w+)$", 2).alias("kind"), "content")
    side = lambda kind: files.filter(F.col("kind") == kind).select("stem", F.col("content").alias(kind))
    return side("shp").join(side("dbf"), "stem").select("shp", "dbf").mapInArrow(_read(names), ", ".join([*[f"`{n}` long" for n in names], "points array<double>"]))


def write_shapefiles(polygons: DataFrame, folder: str) -> None:
    polygons.sparkSession.dataSource.register(ShapefileSource)
    polygons.write.format("shapefile").mode("append").save(folder)
