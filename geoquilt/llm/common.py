"""What the corpus operators share: shared-folder workspaces, table access, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the Arrow batches so that a
    worker never holds more than a few MB of long texts at once."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    if spark.sparkContext.master.startswith("local"):
        shared_dir(spark)  # so that checkpoint() has one


def forget_codecs() -> None:
    """For workers that served another operator before: frees the encoder's tables, which they
    would hold beside their own."""
    module = sys.modules.get("geoquilt.llm.bpe")
    if module is not None and module._codec.cache_info().currsize:
        module._codec.cache_clear()
        give_back()


def give_back() -> None:
    """Returns a worker's free memory to the system, as it may wait for its next task."""
    gc.collect()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the
    session. Only a local master without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if folder:
        if not known:
            context.setCheckpointDir(folder)
        return folder
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="geoquilt-"))
    return context.getCheckpointDir()


def workspace(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem of a path, and its Path class."""
    jvm = spark.sparkContext._jvm
    cls = jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def remove(spark: SparkSession, path: str) -> None:
    fs, cls = filesystem(spark, path)
    fs.delete(cls(path), True)


def stored(spark: SparkSession, df: DataFrame, tag: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table of the shared folder and read it back: cuts the lineage in a
    way that survives lost executors."""
    path = workspace(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, bound: int
) -> DataFrame:
    """(doc_id, text, y) of at most `bound` labelled documents outside the held-out fold, one
    row each.

    The held-out fold is crc32(doc_id as text) mod folds = held. Which rows are taken
    beyond the bound follows from a hash of the id alone. Labels that are null or not 0
    or 1 are ignored; of contradicting labels of one document the greater holds.
    """
    key = F.crc32(F.col("doc_id").cast("string"))
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (key % folds != held))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    # `bound` rows of 12 bytes: the broadcast has a fixed size
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a document that several rows give has the text of the least hash
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), first)
    return found.select("doc_id", "first.text", "y")


def held_out(folds: int, held: int):
    """Null ids hash as the empty string."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return key % folds == held
