"""Fixed-width binary point files as a Spark data source, little-endian throughout.

format("pointfile") with option layout:

classic   i32 count, then i32 id, f64 x, f64 y, i32 geo, i32 attr, i32 n, f64[12] per point
plain     i32 count, then i32 id, f64 x, f64 y, i32 n, f64[12] per point, without labels
compact   i32 count, then i32 id, f64 x, f64 y, i32 label, i32 n, f64[n] per point, one n a file
loose     no count; i32 id, f64 x, f64 y, i32 n, f64[n], i32 geo, i32 attr per point

Records of the first three have one size, so a file is split by offset; the last is read from its
start. A directory is read file by file. Writers put a whole file per task; coalesce(1) gives
one. Rows come as (id, x, y, geo, attr, features), (id, x, y, features) if plain, or
(id, x, y, label, features) if compact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from geoquilt.sources.files import read_points_csv

# Fixed values of the formats.
CLASSIC, PLAIN, COMPACT, LOOSE = "classic", "plain", "compact", "loose"
#: Label columns of each layout.
LABELS = {CLASSIC: ["geo", "attr"], PLAIN: [], COMPACT: ["label"], LOOSE: ["geo", "attr"]}
SLOTS = 12
#: Records of one task and of one Arrow batch.
TASK_RECORDS, BATCH_RECORDS = 1 << 20, 1 << 16
_PLACE = [("id", "<i4"), ("x", "<f8"), ("y", "<f8")]


def record(layout: str, n: int) -> np.dtype:
    if layout == CLASSIC:
        return np.dtype([*_PLACE, ("geo", "<i4"), ("attr", "<i4"), ("n", "<i4"), ("features", "<f8", (SLOTS,))])
    if layout == PLAIN:
        return np.dtype([*_PLACE, ("n", "<i4"), ("features", "<f8", (SLOTS,))])
    if layout == COMPACT:
        return np.dtype([*_PLACE, ("label", "<i4"), ("n", "<i4"), ("features", "<f8", (n,))])
    return np.dtype([*_PLACE, ("n", "<i4"), ("features", "<f8", (n,)), ("geo", "<i4"), ("attr", "<i4")])


def schema_of(layout: str) -> str:
    labels = "".join(f"{c} int, " for c in LABELS[layout])
    return f"id int, x double, y double, {labels}features array<double>"


def _filesystem(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = _filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted((f.path, f.size) for f in found)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(info.path, info.size)]


class Part(InputPartition):
    def __init__(self, file: str, first: int, records: int, width: int):
        super().__init__((file, first, records, width))


class PointReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.layout = options["path"], options.get("layout", CLASSIC)
        if self.layout not in LABELS:
            raise ValueError(f"no such layout: {self.layout}")
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        parts, left = [], self.limit
        fs, _ = _filesystem(self.path)
        for file, size in _files(self.path):
            if self.layout == LOOSE:
                parts.append(Part(file, 0, -1, 0))
                continue
            with fs.open_input_file(file) as f:
                head = f.read(4)
                if len(head) < 4:
                    raise ValueError(f"{file} has no count")
                (count,) = struct.unpack("<i", head)
                width = SLOTS
                if self.layout == COMPACT and count:
                    f.seek(4 + 24)
                    (width,) = struct.unpack("<i", f.read(4))
            unit = record(self.layout, width).itemsize
            if size != 4 + count * unit:
                raise ValueError(f"{file} has {size} bytes; {count} points take {4 + count * unit}")
            count = count if left is None else min(count, left)
            left = left if left is None else left - count
            parts += [Part(file, i, min(TASK_RECORDS, count - i), width) for i in range(0, count, TASK_RECORDS)]
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, first, records, width = partition.value
        if not file:
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(file) as f:
            if self.layout == LOOSE:
                yield from self._loose(f)
                return
            kind = record(self.layout, width)
            f.seek(4 + first * kind.itemsize)
            while records > 0:
                n = min(records, BATCH_RECORDS)
                yield self._batch(np.frombuffer(f.read(n * kind.itemsize), kind))
                records -= n

    def _batch(self, rows: np.ndarray, features: pa.Array | None = None) -> pa.RecordBatch:
        if features is None:
            sizes = np.minimum(rows["n"], rows["features"].shape[1]).astype(np.int64)
            used = rows["features"][np.arange(rows["features"].shape[1])[None] < sizes[:, None]]
            features = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(used))
        names = ["id", "x", "y", *LABELS[self.layout]]
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[c])) for c in names], features], names=[*names, "features"])

    def _loose(self, f) -> Iterator[pa.RecordBatch]:
        data, at, left = f.read(), 0, self.limit
        while at < len(data) and (left is None or left > 0):
            # runs of records of one length
            (n,) = struct.unpack_from("<i", data, at + 20)
            kind = record(LOOSE, n)
            most = (len(data) - at) // kind.itemsize
            if not most:
                raise ValueError(f"the record at byte {at} is cut off")
            rows = np.frombuffer(data, kind, min(most, BATCH_RECORDS if left is None else min(left, BATCH_RECORDS)), at)
            same = rows["n"] == n
            rows = rows if same.all() else rows[: int(same.argmin())]
            yield self._batch(rows)
            at += len(rows) * kind.itemsize
            left = left if left is None else left - len(rows)


class PointWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.layout = options["path"], options.get("layout", CLASSIC)
        self.names = schema.fieldNames()
        fs, at = _filesystem(self.path)
        if overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            for file, _ in _files(self.path):
                fs.delete_file(file)
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get()
        fs, at = _filesystem(self.path)
        name = f"{at.rstrip('/')}/part-{part.partitionId():05d}.bin"
        aside = f"{at.rstrip('/')}/.{name.rsplit('/', 1)[1]}.{part.taskAttemptId()}"
        count, width = 0, None
        with fs.open_output_stream(aside) as f:
            if self.layout != LOOSE:
                f.write(b"\0\0\0\0")
            for batch in iterator:
                if not batch.num_rows:
                    continue
                sizes, matrix = _matrix(batch.column("features"))
                if self.layout == COMPACT:
                    width = int(sizes[0]) if width is None else width
                    if (sizes != width).any():
                        raise ValueError("all points of a compact file have as many features")
                f.write(self._packed(batch, sizes, matrix))
                count += batch.num_rows
        if not count:
            fs.delete_file(aside)
        elif self.layout == LOOSE:
            fs.move(aside, name)
        elif isinstance(fs, pafs.LocalFileSystem):  # the count is known only now
            with open(aside, "r+b") as f:
                f.write(struct.pack("<i", count))
            fs.move(aside, name)
        else:  # streams of other stores can't go back
            with fs.open_input_stream(aside) as old, fs.open_output_stream(f"{aside}.n") as new:
                old.read(4)
                new.write(struct.pack("<i", count))
                while data := old.read(1 << 22):
                    new.write(data)
            fs.delete_file(aside)
            fs.move(f"{aside}.n", name)
        return WriterCommitMessage()

    def _packed(self, batch: pa.RecordBatch, sizes: np.ndarray, matrix: np.ndarray) -> bytes:
        if self.layout == LOOSE:  # runs of points of one length share a record type
            out, cuts = [], np.flatnonzero(np.diff(sizes)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                out.append(self._records(batch, sizes, matrix[:, : sizes[low]], int(low), int(high)))
            return b"".join(out)
        if self.layout in (CLASSIC, PLAIN):
            sizes = np.minimum(sizes, SLOTS)
            full = np.zeros((len(sizes), SLOTS))
            full[:, : min(SLOTS, matrix.shape[1])] = matrix[:, :SLOTS]
            matrix = full
        return self._records(batch, sizes, matrix, 0, len(sizes))

    def _records(self, batch: pa.RecordBatch, sizes: np.ndarray, matrix: np.ndarray, low: int, high: int) -> bytes:
        rows = np.zeros(high - low, record(self.layout, matrix.shape[1]))
        for c in ("id", "x", "y", *LABELS[self.layout]):
            rows[c] = batch.column(c).slice(low, high - low).to_numpy(zero_copy_only=False)
        rows["n"] = sizes[low:high]
        rows["features"] = matrix[low:high]
        return rows.tobytes()


def _matrix(features: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of lists, and their values row by row in front of zeros; nulls are zeros."""
    sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
    flat = features.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    matrix[np.arange(matrix.shape[1])[None] < sizes[:, None]] = flat
    return sizes, matrix


class PointFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointfile"

    def schema(self) -> str:
        return schema_of(self.options.get("layout", CLASSIC))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PointReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PointWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("pointfile") known to a session."""
    spark.dataSource.register(PointFile)


def sorted_export(df, path: str, x: str = "x", y: str = "y") -> None:
    """Compact files whose points are in order of place, within and across files."""
    register(df.sparkSession)
    ordered = df.repartitionByRange(x, y).sortWithinPartitions(x, y, "id")
    ordered.write.format("pointfile").option("layout", COMPACT).mode("append").save(path)


def convert_csv(spark: SparkSession, source: str, path: str, features: int, layout: str = CLASSIC) -> None:
    """Points of CSV files (files.points_schema's columns, with a header) as binary files, one of
    each task; rows are neither collected nor shuffled. The compact layout takes `geo` as label."""
    register(spark)
    points = read_points_csv(spark, source, features, most_features=SLOTS)
    labels = [F.col("geo").alias("label")] if layout == COMPACT else LABELS[layout]
    rows = points.df.select("id", "x", "y", *labels, F.array(*points.features).alias("features"))
    rows.write.format("pointfile").option("layout", layout).mode("append").save(path)
