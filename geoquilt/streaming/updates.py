"""Points and events that keep arriving: windowed counts, and layouts whose summaries follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoquilt.operators import similarity
from geoquilt.operators.layout import Grid
from geoquilt.schema import PointSet


def windowed_counts(events: DataFrame, ts: str, cluster: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(cluster, start, n) per tumbling window; events later than `late` are left out."""
    window = F.window("__ts", width)
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = timed.withWatermark("__ts", late).groupBy(window.alias("w"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    return rows.select("cluster", F.col("w.start").alias("start"), "n")


class GroupSummary:
    """A layout and its (cell, label) summary in folders, updated batch by batch. A batch is
    written under its number, so that one that is run again replaces itself; only summaries of
    cells that it touches are computed anew."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, features: tuple[str, ...], label: str = "label"):
        self.spark, self.path, self.grid, self.features, self.label = spark, path.rstrip("/"), grid, features, label

    def add(self, rows: DataFrame, batch: int) -> None:
        placed = self.grid.assign(rows)
        placed.write.mode("overwrite").parquet(f"{self.path}/points/batch={batch}")
        touched = self.spark.read.parquet(f"{self.path}/points/batch={batch}").select("cell").distinct()
        whole = PointSet(self.points().join(touched, "cell", "left_semi"), self.features, (self.label,))
        similarity.leaf_groups(whole, self.label).write.mode("overwrite").parquet(f"{self.path}/summary/batch={batch}")

    def points(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/points").parquet(f"{self.path}/points")

    def summary(self) -> DataFrame:
        """The newest summary of every cell."""
        rows = self.spark.read.option("basePath", f"{self.path}/summary").parquet(f"{self.path}/summary")
        newest = rows.groupBy("cell").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["cell", "batch"], "left_semi").drop("batch")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs what has arrived and stops."""
        query = stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint)
        return query.trigger(availableNow=True).start()
