"""CSV and Parquet tables of points, and small file chores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquilt.schema import PointSet, require_columns


def points_schema(features: int) -> T.StructType:
    """Column order of point files: labels, id, place, features."""
    fields = [("geo", T.IntegerType()), ("attr", T.IntegerType()), ("id", T.IntegerType()), ("x", T.DoubleType()), ("y", T.DoubleType())]
    fields += [(f"f{i}", T.DoubleType()) for i in range(features)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_points_csv(spark: SparkSession, path: str, features: int, limit: int | None = None, most_features: int = 8) -> PointSet:
    """Points of a CSV file with a header, by position. Rows that can't be read are dropped, empty
    lines skipped; features beyond `most_features` are left out."""
    df = spark.read.schema(points_schema(features)).csv(path, header=True, mode="DROPMALFORMED", enforceSchema=True)
    df = df if limit is None else df.limit(limit)
    return PointSet(df, tuple(f"f{i}" for i in range(features)), ("geo", "attr")).capped(most_features)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """With a header; doubles to a fixed number of digits on request."""
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").csv(path, header=True)


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines of a CSV file but for its header."""
    return spark.read.csv(path, header=True).count()


def head_copy(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a
    local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="geoquilt-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return require_columns(df, names)


def zeros_for_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
