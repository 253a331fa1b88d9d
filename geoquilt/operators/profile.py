"""Column statistics, cluster statistics and percentiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The percentiles of the usual report: tens, then the last ten, then the last tenths.
TENS = tuple(range(0, 101, 10))
LAST_TEN = tuple(range(90, 101))
#: Value ranges in which positions are counted apart.
RANGES = 64
LAST_TENTHS = tuple(round(99 + i / 10, 1) for i in range(10)) + (100,)


def _positions(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(column, value, from, upto): the positions that each distinct value, a double, takes in its
    sorted column, nulls left out; and (column, total). Distinct values are counted first, so that the
    running count goes over these. It runs within value ranges of about equal size, cut at
    approximate quantiles (one job when this is called), and over the ranges' totals: no task
    sorts everything."""
    cuts = df.approxQuantile(list(columns), [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)
    splits = [[-math.inf, *(sorted(c for c in set(of) if math.isfinite(c)) or [0.0]), math.inf] for of in cuts]
    named = [f"__{i}" for i in range(len(columns))]
    doubles = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, named, strict=True)])
    placed = Bucketizer(splitsArray=splits, inputCols=named, outputCols=[f"{n}_part" for n in named], handleInvalid="keep").transform(doubles)
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(n).alias("value"), F.col(f"{n}_part").cast("int").alias("part"))
        for c, n in zip(columns, named, strict=True)
    ]
    rows = placed.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where(F.col("value").isNotNull())
    ordered = rows.groupBy("column", "part", "value").agg(F.count("*").alias("n"))
    within = F.sum("n").over(W.partitionBy("column", "part").orderBy("value"))
    parts = ordered.groupBy("column", "part").agg(F.sum("n").alias("of_part"))
    upto = F.sum("of_part").over(W.partitionBy("column").orderBy("part"))  # RANGES rows
    before = parts.select("column", "part", (upto - F.col("of_part")).alias("before"))
    placed = ordered.withColumn("within", within).join(F.broadcast(before), ["column", "part"])
    placed = placed.select("column", "value", (F.col("before") + F.col("within")).alias("upto"), "n")
    totals = ordered.groupBy("column").agg(F.sum("n").alias("total"))
    return placed.select("column", "value", (F.col("upto") - F.col("n")).alias("from"), "upto"), totals


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, share, value): exact quantiles, between two values in proportion. Columns without
    values have no rows."""
    placed, totals = _positions(df, columns)
    at = F.col("share") * (F.col("total") - 1)
    asked = totals.select("column", "total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.select("column", "share", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    inside = lambda c: (F.col(c) >= F.col("from")) & (F.col(c) < F.col("upto"))
    met = placed.join(F.broadcast(asked), "column").where(inside("low") | inside("high"))  # a few rows a column
    ends = met.groupBy("column", "share", "part").agg(
        F.max(F.when(inside("low"), F.col("value"))).alias("a"), F.max(F.when(inside("high"), F.col("value"))).alias("b")
    )
    return ends.select("column", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, minimum, maximum, mean, median, sample deviation, negatives, zeros,
    nulls and the share of nulls. One pass over all columns, and the medians."""
    def stats(c):
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.count_if(v < 0).alias("negatives"), F.count_if(v == 0).alias("zeros"), F.count_if(v.isNull()).alias("nulls"),
            F.try_divide(F.count_if(v.isNull()) * F.lit(100.0), F.count("*")).alias("null_percent"),
        )

    rows = df.agg(F.array(*[stats(c) for c in columns]).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    medians = quantiles(df, columns, [0.5]).select("column", F.col("value").alias("median"))
    both = rows.join(F.broadcast(medians), "column", "left")  # a row a column
    return both.select("column", "n", "min", "max", "mean", "median", "std", "negatives", "zeros", "nulls", "null_percent")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated), max."""
    v = F.col(column).cast("double")
    row = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, [column], [0.25, 0.5, 0.75]).groupBy().pivot("share", [0.25, 0.5, 0.75]).agg(F.max("value")).toDF("q25", "q50", "q75")
    return row.join(F.broadcast(q)).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row each


def total_check(df: DataFrame, parts: Sequence[str], total: str, tolerance: float = 0.01) -> DataFrame:
    """Largest and mean difference of a total and the sum of its parts, and rows beyond a bound."""
    whole = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    off = F.abs(F.col(total) - whole)
    return df.agg(F.max(off).alias("max_off"), F.avg(off).alias("mean_off"), F.count_if(off > tolerance).alias("rows_off"))


def sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def size_summary(df: DataFrame, label: str) -> DataFrame:
    return sizes(df, label).agg(F.count("*").alias("clusters"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))


def cluster_meta(df: DataFrame, geo: str, attr: str, x: str = "x", y: str = "y") -> DataFrame:
    """Per cluster: distinct subclusters, rows and coordinate ranges to six digits."""
    r = lambda f, c, name: F.round(f(c), 6).alias(name)
    return df.groupBy(geo).agg(
        F.count_distinct(attr).alias("subclusters"), F.count("*").alias("n"),
        r(F.min, x, "x_min"), r(F.max, x, "x_max"), r(F.min, y, "y_min"), r(F.max, y, "y_max"),
    )


def subcluster_sizes(df: DataFrame, geo: str, attr: str) -> DataFrame:
    return df.groupBy(geo, attr).agg(F.count("*").alias("n"))


def run_summary(df: DataFrame, geo: str, attr: str) -> DataFrame:
    """Rows, distinct labels and ranges of a whole point set."""
    return df.agg(
        F.count("*").alias("n"), F.count_distinct(geo).alias("clusters"), F.count_distinct(geo, attr).alias("subclusters"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )


def split_outliers(df: DataFrame, label: str, outlier=-1) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, outliers); rows without a label are labelled."""
    out = F.coalesce(F.col(label) == F.lit(outlier), F.lit(False))
    return df.where(~out), df.where(out)


def positional_percentiles(df: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """(p, value): the value at position int(n * (p / 100)) of the sorted column, at 100 the last.
    Nulls are left out; equal values share a range of positions."""
    placed, totals = _positions(df.select(column), [column])
    asked = totals.select("total", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p"))
    at = F.least(F.floor(F.col("total") * (F.col("p") / 100)), F.col("total") - 1)
    asked = asked.withColumn("at", at)
    # ranges are disjoint, and the asked few: each finds one row
    return placed.join(F.broadcast(asked), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto"))).select("p", "value")


def kept_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, and the share that is left."""
    a, b = before.agg(F.count("*").alias("before")), after.agg(F.count("*").alias("after"))
    return a.join(F.broadcast(b)).withColumn("share", F.try_divide(F.col("after"), F.col("before")))


def same_ids(a: DataFrame, b: DataFrame, id: str = "id") -> DataFrame:
    """Ids in one of two sets alone, with where they are."""
    left, right = a.select(id).distinct().withColumn("in_a", F.lit(True)), b.select(id).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, id, "full")
    return both.where("in_a is null or in_b is null").select(id, F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))
