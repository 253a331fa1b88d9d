"""Filters and repairs of raw trips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.schema import Box

# Fixed values, on which results depend.
#: Bounds of the city, as (south, west, north, east) degrees.
CITY = Box(40.5774, -74.15, 40.9176, -73.7004)
#: Exclusive bounds of plausible trips: minutes, miles an hour, miles, dollars.
MINUTES, SPEED, MILES, FARE = (1, 720), (0, 45.31), (0, 23), (0, 1000)


def in_city(df: DataFrame, lat: str, lon: str, box: Box = CITY) -> DataFrame:
    """Edges count."""
    return df.where(box.contains(lat, lon))


def inside_city(df: DataFrame, lat: str, lon: str, box: Box = CITY) -> DataFrame:
    """Edges don't count."""
    return df.where(box.contains_open(lat, lon))


def location_outliers(df: DataFrame, ends: Sequence[tuple[str, str]], box: Box = CITY) -> DataFrame:
    """Rows of which an end (lat, lon) is on the edge or outside."""
    out = [~box.contains_open(lat, lon) for lat, lon in ends]
    return df.where(reduce(lambda a, b: a | b, out))


def invalid_coordinates(lat: str, lon: str) -> Column:
    """0, 0 or beyond the globe."""
    la, lo = F.col(lat), F.col(lon)
    return ((la == 0) & (lo == 0)) | (F.abs(la) > 90) | (F.abs(lo) > 180)


def coordinate_report(df: DataFrame, lat: str, lon: str) -> DataFrame:
    la, lo = F.col(lat), F.col(lon)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if((la == 0) & (lo == 0)).alias("null_island"),
        F.count_if(F.abs(la) > 90).alias("bad_lat"),
        F.count_if(F.abs(lo) > 180).alias("bad_lon"),
    )


def clip_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Below 0 becomes 0; nulls stay."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def shift_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with a negative minimum move up by its size, rounded to cents. One pass of minima
    for all columns, joined as one row."""
    low = df.agg(*[F.least(F.min(c), F.lit(0.0)).alias(f"low_{c}") for c in columns])
    moved = {c: F.when(F.col(f"low_{c}") < 0, F.round(F.col(c) - F.col(f"low_{c}"), 2)).otherwise(F.col(c)) for c in columns}
    return df.join(F.broadcast(low)).withColumns(moved).drop(*[f"low_{c}" for c in columns])


def recomputed_total(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """The sum of the parts that are there, in cents."""
    whole = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    return df.withColumn(total, F.round(whole, 2))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def durations(df: DataFrame, start: str, end: str, miles: str) -> DataFrame:
    """With `minutes` and `mph`; no speed without a duration."""
    minutes = (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60.0
    out = df.withColumn("minutes", minutes)
    return out.withColumn("mph", F.try_divide(F.lit(60.0) * F.col(miles), F.col("minutes")))


def between_open(c: str, bounds: tuple[float, float]) -> Column:
    return (F.col(c) > bounds[0]) & (F.col(c) < bounds[1])


def without_outliers(df: DataFrame, ends: Sequence[tuple[str, str]], miles: str, fare: str | None = None, box: Box = CITY) -> DataFrame:
    """Trips inside the city at both ends with plausible duration, speed, distance and, on
    request, fare. Needs what durations() adds. (Our definition.)"""
    tests = [box.contains_open(lat, lon) for lat, lon in ends]
    tests += [between_open("minutes", MINUTES), between_open("mph", SPEED), between_open(miles, MILES)]
    if fare is not None:
        tests.append(between_open(fare, FARE))
    return df.where(reduce(lambda a, b: a & b, tests))


def log_of(c: str) -> Column:
    """Natural logarithm; null at 0 and below."""
    return F.when(F.col(c) > 0, F.ln(F.col(c)))


def round_half_even(c: str, digits: int) -> Column:
    return F.bround(F.col(c), digits)


def sample(df: DataFrame, n: int, id: str = "id") -> DataFrame:
    """n rows in the order of a hash of the id: the same for the same rows."""
    return df.orderBy(F.xxhash64(id), id).limit(n)


def extremes(df: DataFrame, c: str, below: float, n: int = 2, id: str = "id") -> DataFrame:
    """The first n rows, by id, with a value below a bound."""
    return df.where(F.col(c) < below).orderBy(id).limit(n)


def arranged(df: DataFrame, columns: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Columns in a new order under new names {new: old}, some cast."""
    types = types or {}
    return df.select(*[(F.col(old).cast(types[new]) if new in types else F.col(old)).alias(new) for new, old in columns.items()])
