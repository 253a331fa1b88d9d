"""Points and boxes: the data model of the engine.

A point set is a DataFrame with columns id, x, y, optional labels and one DOUBLE column per
feature (f0, f1, ...). Features stay apart, so that Parquet prunes them and distances compile to
plain arithmetic; `with_vector` gives them as an array. x and y are top-level doubles, so that
box filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Box:
    """A closed box; the empty box has no side (all None)."""

    x0: float | None = None
    y0: float | None = None
    x1: float | None = None
    y1: float | None = None

    def __post_init__(self):
        sides = (self.x0, self.y0, self.x1, self.y1)
        if any(s is None for s in sides) and any(s is not None for s in sides):
            raise ValueError("give all four sides or none")

    @property
    def empty(self) -> bool:
        return self.x0 is None or self.x0 > self.x1 or self.y0 > self.y1

    def contains(self, x: ColumnLike, y: ColumnLike) -> Column:
        """Closed on all sides; nothing is in the empty box."""
        if self.empty:
            return F.lit(False)
        return column(x).between(self.x0, self.x1) & column(y).between(self.y0, self.y1)

    def contains_open(self, x: ColumnLike, y: ColumnLike) -> Column:
        """Open on all sides."""
        if self.empty:
            return F.lit(False)
        x, y = column(x), column(y)
        return (x > self.x0) & (x < self.x1) & (y > self.y0) & (y < self.y1)

    def stretched(self, other: Box) -> Box:
        if self.empty or other.empty:
            return other if self.empty else self
        return Box(min(self.x0, other.x0), min(self.y0, other.y0), max(self.x1, other.x1), max(self.y1, other.y1))


@dataclass(frozen=True)
class PointSet:
    df: DataFrame
    features: tuple[str, ...] = ()
    labels: tuple[str, ...] = field(default=())

    @classmethod
    def of(
        cls,
        df: DataFrame,
        id: ColumnLike,
        x: ColumnLike,
        y: ColumnLike,
        features: Sequence[ColumnLike] = (),
        labels: Mapping[str, ColumnLike] | None = None,
        extra: Sequence[str] = (),
    ) -> PointSet:
        """Any table as points. `labels` by name; `extra` columns are carried as payload."""
        names = tuple(f"f{i}" for i in range(len(features)))
        labels = dict(labels or {})
        out = df.select(
            column(id).alias("id"),
            column(x).cast("double").alias("x"),
            column(y).cast("double").alias("y"),
            *(column(c).alias(name) for name, c in labels.items()),
            *(column(c).cast("double").alias(name) for name, c in zip(names, features, strict=True)),
            *extra,
        )
        return cls(out, names, tuple(labels))

    def with_df(self, df: DataFrame) -> PointSet:
        return PointSet(df, self.features, self.labels)

    def capped(self, most: int = 8) -> PointSet:
        """The first `most` features only."""
        return PointSet(self.df.drop(*self.features[most:]), self.features[:most], self.labels)

    def with_vector(self, name: str = "features") -> DataFrame:
        return self.df.withColumn(name, F.array(*self.features))

    def light(self) -> DataFrame:
        """Without features: id, place and labels."""
        return self.df.select("id", "x", "y", *self.labels)

    def duplicates(self) -> DataFrame:
        """Ids that repeat, which the engine's operators do not allow."""
        return self.df.groupBy("id").count().where("count > 1")

    def check_unique(self) -> PointSet:
        worst = self.duplicates().orderBy("id").first()
        if worst is not None:
            raise ValueError(f"point ids must be unique; {worst['id']} occurs {worst['count']} times")
        return self


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, or ValueError naming the columns that it lacks: before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
