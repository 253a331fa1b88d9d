"""Join sides that are broadcast only when they have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast: groups, labels, centres of some 100 bytes each.
FEW = 20_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The rows of df, marked for broadcast, if it has `most` or fewer: computed once and sent from
    the driver. Beyond, df itself, which Spark joins by shuffle. For aggregates, whose rows are
    small."""
    found = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if found.num_rows <= most else df
