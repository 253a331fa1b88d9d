"""Cells in place of tree leaves: a grid computed from the point alone, or slabs balanced by
rank. A layout is written by slab and sorted by cell, so that a box reads few files and few row
groups of these. A version number per write stands for the leaves' mutation counters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.operators.sides import few
from geoquilt.schema import Box


#: Cells of a balanced layout up to which its bounds are part of the plan; of more, they are a
#: small table, which is broadcast.
MOST_CELLS = 10_000


@dataclass(frozen=True)
class Grid:
    """Cells of dx by dy from (x0, y0): `cell` is 'gx:gy', a slab is one gx."""

    x0: float
    y0: float
    dx: float
    dy: float

    def __post_init__(self):
        if self.dx <= 0 or self.dy <= 0:
            raise ValueError("cells need a positive size")

    def assign(self, points: DataFrame) -> DataFrame:
        gx = F.floor((F.col("x") - F.lit(self.x0)) / F.lit(self.dx))
        gy = F.floor((F.col("y") - F.lit(self.y0)) / F.lit(self.dy))
        placed = points.withColumns({"gx": gx, "gy": gy})
        return placed.withColumn("cell", F.concat_ws(":", "gx", "gy"))

    def slabs(self, box: Box) -> tuple[int, int]:
        return math.floor((box.x0 - self.x0) / self.dx), math.floor((box.x1 - self.x0) / self.dx)

    def in_box(self, placed: DataFrame, box: Box) -> DataFrame:
        """The box filter and what follows for slabs and cells, which prunes directories."""
        if box.empty:
            return placed.where(F.lit(False))
        low, high = self.slabs(box)
        bottom = math.floor((box.y0 - self.y0) / self.dy)
        top = math.floor((box.y1 - self.y0) / self.dy)
        return placed.where(F.col("gx").between(low, high) & F.col("gy").between(bottom, top) & box.contains("x", "y"))


@dataclass(frozen=True)
class Slabs:
    """Sort-tile layout: slabs by x of about equal numbers, cells by y in each. Bounds come from
    approximate quantiles, so no task sorts everything; points are then placed by their own
    coordinates alone."""

    x_bounds: tuple[float, ...]
    y_bounds: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, points: DataFrame, rows_per_cell: int, error: float = 0.001) -> Slabs:
        if rows_per_cell < 2:
            raise ValueError("a cell holds two rows at least")
        n = points.count()
        cells = max(1, math.ceil(n / rows_per_cell))
        across = max(1, math.ceil(math.sqrt(cells)))
        down = max(1, math.ceil(cells / across))
        cut = lambda k: [i / k for i in range(1, k)]
        xs = tuple(points.approxQuantile("x", cut(across), error)) if n and across > 1 else ()
        if not n or down == 1:
            return cls(xs, tuple(() for _ in range(len(xs) + 1)))
        share = F.percentile_approx("y", F.array(*map(F.lit, cut(down))), int(1 / error))
        per_slab = points.withColumn("slab", cls._place(F.col("x"), xs)).groupBy("slab").agg(share.alias("ys"))
        found = {r["slab"]: tuple(r["ys"]) for r in per_slab.collect()}  # one row per slab
        return cls(xs, tuple(found.get(i, ()) for i in range(len(xs) + 1)))

    @staticmethod
    def _place(c, bounds):
        if not bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= c))

    def assign(self, points: DataFrame) -> DataFrame:
        placed = points.withColumn("gx", self._place(F.col("x"), self.x_bounds).cast("long"))
        if sum(len(ys) + 1 for ys in self.y_bounds) > MOST_CELLS:
            slabs = [(i, [float(b) for b in ys]) for i, ys in enumerate(self.y_bounds)]
            bounds = points.sparkSession.createDataFrame(slabs, "gx long, __ys array<double>")
            placed = placed.join(F.broadcast(bounds), "gx", "left").select(*placed.columns, "__ys")
            mine = F.col("__ys")
        else:
            rows = F.array(*[F.array(*[F.lit(float(b)) for b in ys]).cast("array<double>") for ys in self.y_bounds])
            mine = F.get(rows, F.col("gx").cast("int"))
        placed = placed.withColumn("gy", F.size(F.filter(mine, lambda b: b <= F.col("y"))).cast("long")).drop("__ys")
        return placed.withColumn("cell", F.concat_ws(":", "gx", "gy"))


def splits(placed: DataFrame, least: int) -> DataFrame:
    """Ways to cut each cell's points in two along an axis, `least` or more on each side: (cell,
    axis, first, margin, shared, area) with the sum of the halves' margins, the area they share
    and that of both. Boxes of all prefixes and suffixes are running minima and maxima, from both
    ends, as a frame that ends with its partition is computed anew for each row."""
    both = placed.select("cell", "id", "x", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("axis"))
    key = F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("y"))
    part = W.partitionBy("cell", "axis")
    up = part.orderBy(key, "x", "y", "id")
    down = part.orderBy(key.desc(), F.desc("x"), F.desc("y"), F.desc("id"))
    frames = (("b_", down.rowsBetween(W.unboundedPreceding, -1)), ("a_", up.rowsBetween(W.unboundedPreceding, 0)))
    for prefix, w in frames:
        sides = {f"{prefix}x0": F.min("x").over(w), f"{prefix}y0": F.min("y").over(w)}
        sides |= {f"{prefix}x1": F.max("x").over(w), f"{prefix}y1": F.max("y").over(w)}
        both = both.withColumns(sides | ({"rest": F.row_number().over(down) - 1} if prefix == "b_" else {"first": F.row_number().over(up)}))
    a, b = g.B.named("a_"), g.B.named("b_")
    cuts = both.where((F.col("first") >= least) & (F.col("rest") >= least))
    margin, area = g.margin(a) + g.margin(b), g.area(a) + g.area(b)
    return cuts.select("cell", "axis", "first", margin.alias("margin"), g.overlap(a, b).alias("shared"), area.alias("area"))


def best_splits(placed: DataFrame, most: int, least: int) -> DataFrame:
    """Of every cell that holds more than `most` points, the cut on the axis with the least sum of
    margins (of equals the first) that shares the least area, then covers the least: (cell, axis,
    first, margin, shared, area). A cell with fewer than two times `least` has none. Cells that
    hold many times `most` are for refine(), which sorts nothing."""
    full = few(placed.groupBy("cell").count().where(F.col("count") > most).select("cell"))
    best = F.min_by(F.struct("first", "margin", "shared", "area"), F.struct("shared", "area", "first"))
    cuts = splits(placed.join(full, "cell", "left_semi"), least)
    by_axis = cuts.groupBy("cell", "axis").agg(F.sum("margin").alias("total"), best.alias("cut"))
    chosen = by_axis.groupBy("cell").agg(F.min_by(F.struct("axis", "cut"), F.struct("total", "axis")).alias("s"))
    return chosen.select("cell", "s.axis", "s.cut.*")


def best_split(points: DataFrame, least: int) -> DataFrame:
    """The best cut of points that are one cell: one row, or none if they are too few."""
    return best_splits(points.withColumn("cell", F.lit("")), 0, least).drop("cell")


def refine(points: DataFrame, grid: Grid, most: int, depth: int) -> DataFrame:
    """points with gx, gy, level and cell 'level:gx:gy': grid cells that hold more than `most`
    points are cut into four, and these again, down to `depth` cuts, below which a cell keeps
    what it holds. Points are placed by their coordinates alone, so points of equal place stay
    together. What is left after deletions, refined again, has its under-full cells merged.

    Points are counted by the finest cell before anything is shuffled; the levels come from
    these counts. A place without coordinates has level, cell and numbers null."""
    if most < 1 or not 0 <= depth <= 20:
        raise ValueError("cells hold a point at least and are cut 0 to 20 times")
    fine = lambda c, zero, size: F.floor((F.col(c) - F.lit(zero)) / F.lit(size / 2**depth))
    placed = points.withColumns({"__fx": fine("x", grid.x0, grid.dx), "__fy": fine("y", grid.y0, grid.dy)})
    counts = placed.where("__fx is not null and __fy is not null").groupBy("__fx", "__fy").agg(F.count("*").alias("__n"))
    at = lambda c, level: F.shiftright(F.col(c), depth - level)
    level = F.lit(depth)
    held = counts
    for k in range(depth):
        held = held.withColumn(f"__n{k}", F.sum("__n").over(W.partitionBy(at("__fx", k), at("__fy", k))))
    for k in reversed(range(depth)):
        level = F.when(F.col(f"__n{k}") <= most, k).otherwise(level)
    levels = held.select("__fx", "__fy", level.alias("level"))
    down = F.lit(depth) - F.col("level")
    found = placed.join(few(levels), ["__fx", "__fy"], "left").withColumns(
        {c: F.call_function("shiftright", F.col(f), down) for c, f in (("gx", "__fx"), ("gy", "__fy"))}
    )
    cell = F.when(F.col("level").isNotNull(), F.concat_ws(":", "level", "gx", "gy"))
    return found.withColumn("cell", cell).drop("__fx", "__fy")


def cell_stats(placed: DataFrame) -> DataFrame:
    """(cell, gx, gy, n, x0, y0, x1, y1): one row per cell that holds points."""
    return placed.groupBy("cell", "gx", "gy").agg(F.count("*").alias("n"), *g.box_of())


def cells_meeting(stats: DataFrame, box: Box) -> DataFrame:
    """Cells whose points' box meets the box, touching included."""
    if box.empty:
        return stats.where(F.lit(False))
    return stats.where(g.intersects(g.B.named(""), g.B.of(box.x0, box.y0, box.x1, box.y1)))


def nearest_cell(stats: DataFrame, x: float, y: float) -> DataFrame:
    """The cell whose box has its centre nearest to a place; of equals the first by name."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    d = g.planar_distance(F.lit(x), F.lit(y), cx, cy)
    return stats.withColumn("distance", d).orderBy("distance", "cell").limit(1)


def sibling_cells(stats: DataFrame, cell: str, box: Box) -> DataFrame:
    """Other cells of the same slab that meet a box."""
    own = stats.where(F.col("cell") == cell).select(F.col("gx").alias("own"))
    return cells_meeting(stats, box).join(F.broadcast(own), F.col("gx") == F.col("own")).where(F.col("cell") != cell).drop("own")


def density(points: DataFrame, box: Box, width: int, height: int) -> DataFrame:
    """(px, py, n): counts on a raster of width by height over a box; the far edges belong to
    the last column and row."""
    dx, dy = (box.x1 - box.x0) / width, (box.y1 - box.y0) / height
    px = F.least(F.floor((F.col("x") - F.lit(box.x0)) / F.lit(dx)), F.lit(width - 1))
    py = F.least(F.floor((F.col("y") - F.lit(box.y0)) / F.lit(dy)), F.lit(height - 1))
    return points.where(box.contains("x", "y")).groupBy(px.alias("px"), py.alias("py")).agg(F.count("*").alias("n"))


def save(placed: DataFrame, path: str, version: int = 1) -> None:
    """Written as slabs (directories), each range-split by cell, sorted by cell and place."""
    (
        placed.withColumn("version", F.lit(version))
        .repartitionByRange("gx", "gy", "x")
        .sortWithinPartitions("gx", "gy", "x", "y")
        .write.partitionBy("gx")
        .parquet(path)
    )


def load(spark, path: str, expected: Grid | None = None, written: Grid | None = None) -> DataFrame:
    """What save() wrote. Given both, the grid that it is read by has to be the one it was
    written by."""
    if expected is not None and written is not None and expected != written:
        raise ValueError(f"the layout was written with {written}, not {expected}")
    return spark.read.parquet(path).withColumn("gx", F.col("gx").cast("long"))


def versions(placed: DataFrame, changed: DataFrame, version: int) -> DataFrame:
    """(cell, version): cells that got a row in `changed` (with `cell`) have the new version."""
    touched = changed.select("cell").distinct().withColumn("new", F.lit(version))
    now = placed.groupBy("cell").agg(F.max("version").alias("version")) if "version" in placed.columns else (
        placed.select("cell").distinct().withColumn("version", F.lit(version - 1))
    )
    return now.join(touched, "cell", "full").select("cell", F.coalesce("new", "version").alias("version"))
