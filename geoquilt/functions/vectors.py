"""Distances of feature vectors. With the features as columns, they unroll to arithmetic that
compiles into the stage; arrays of unknown length take a higher-order function."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance; the shorter vector sets the length."""
    terms = [(x - y) * (x - y) for x, y in zip(a, b, strict=False)]
    return reduce(lambda s, t: s + t, terms) if terms else F.lit(0.0)


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of arrays of any lengths; the shorter sets the length."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, t: s + t))


def similarity(a: Sequence[Column], b: Sequence[Column], most: int = 8) -> Column:
    """exp(-distance) over the first `most` features: 1 for equal vectors."""
    return F.exp(-F.sqrt(distance2(a[:most], b[:most])))


def padded(values: Column, length: int) -> Column:
    """An array cut or filled with zeros to a length; null elements become zero."""
    full = F.concat(F.coalesce(values, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), length))
    return F.transform(F.slice(full, 1, length), lambda v: F.coalesce(v, F.lit(0.0)))


def mean_vector(features: Sequence[str]) -> list[Column]:
    return [F.avg(f).alias(f) for f in features]


def sum_vector(features: Sequence[str]) -> list[Column]:
    return [F.sum(f).alias(f) for f in features]
