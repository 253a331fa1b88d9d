"""Searches in space: boxes, nearest neighbours, deletions, ids, and joins of points with boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.schema import Box, PointSet


#: Cells that a filter names; of more, points are joined with them.
MOST_NAMED = 1000


def in_box(points: DataFrame, box: Box) -> DataFrame:
    """All points of the closed box. Both ranges are pushed to the scan."""
    return points.where(box.contains("x", "y"))


def nearest(points: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """The k points nearest to a place, with squared distance and rank; of equals the least id.
    k <= 0 gives none, k beyond the number of points all."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    top = points.withColumn("d2", d2).orderBy("d2", "id").limit(max(k, 0))
    return top.withColumn("rank", F.row_number().over(W.orderBy("d2", "id")))  # of k rows


def nearest_pruned(cells: DataFrame, points: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """nearest() over points laid out in cells (with a `cell` column), reading few of them. The
    nearest cells that hold k points give a distance within which k points are sure to be; no
    cell beyond it is read. cells: layout.cell_stats(), whose size is that of the layout."""
    if k <= 0:
        return nearest(points, x, y, 0)
    box = g.B.named("")
    far_x = F.greatest(F.abs(F.lit(x) - F.col("x0")), F.abs(F.lit(x) - F.col("x1")))
    far_y = F.greatest(F.abs(F.lit(y) - F.col("y0")), F.abs(F.lit(y) - F.col("y1")))
    reach = cells.select(
        "cell", "n", (far_x * far_x + far_y * far_y).alias("far"),
        g.distance2_to_box(box, F.lit(x), F.lit(y)).alias("near"),
    )
    known = reach.limit(MOST_NAMED + 1).collect()
    if len(known) <= MOST_NAMED and "gx" in points.columns:
        bound = _bound(sorted((r["far"], r["n"]) for r in known), k)
        cells = [r["cell"] for r in known if bound is None or r["near"] <= bound]
        slabs = sorted({int(c.split(":")[0]) for c in cells})
        # literals, which prune the layout's directories and row groups
        return nearest(points.where(F.col("gx").isin(slabs) & F.col("cell").isin(cells)), x, y, k)
    # the k cells of least `far` hold k points at least, as no cell is empty
    bound = _bound(reach.orderBy("far", "cell").limit(k).agg(F.sort_array(F.collect_list(F.struct("far", "n")))).first()[0], k)
    wanted = reach if bound is None else reach.where(F.col("near") <= bound)
    return nearest(points.join(wanted.select("cell"), "cell", "left_semi"), x, y, k)


def _bound(cells: list[tuple[float, int]], k: int) -> float | None:
    """The distance within which cells (far, n), in order, hold k points; None if they don't."""
    held = 0
    for far, n in cells:
        held += n
        if held >= k:
            return far
    return None


def without(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Points whose id is not among the deleted."""
    return points.join(tombstones.select("id"), "id", "left_anti")


def deletion(points: DataFrame, x: float, y: float, matching: Column | None = None) -> DataFrame:
    """The id (one row or none) of the point that a deletion at exactly (x, y) removes: the
    least of those that match."""
    here = points.where((F.col("x") == x) & (F.col("y") == y))
    if matching is not None:
        here = here.where(matching)
    return here.orderBy("id").limit(1).select("id")


def meeting(boxes: DataFrame, box: Box, prefix: str = "") -> DataFrame:
    """Boxes that share area with one."""
    return boxes.where(g.intersects_open(g.B.named(prefix), g.B.of(box.x0, box.y0, box.x1, box.y1)))


def not_meeting(boxes: DataFrame, box: Box, prefix: str = "") -> DataFrame:
    """What a deletion by area leaves."""
    return boxes.where(~g.intersects_open(g.B.named(prefix), g.B.of(box.x0, box.y0, box.x1, box.y1)))


def by_id(points: DataFrame, id) -> DataFrame:
    return points.where(F.col("id") == F.lit(id))


def last_wins(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The row of the greatest `order` of each key. One aggregate with partial maxima; no
    window sorts a key's rows."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("best"))
    return best.select(key, "best.*").select(*rows.columns)


@dataclass(frozen=True)
class PointStore:
    """Whole points by id, one row each; ids are not null. A change gives a new store."""

    df: DataFrame
    key: str = "id"

    def upsert(self, rows: DataFrame, order: str) -> PointStore:
        """rows replace the points of their ids or are added; of several rows of an id that of
        the greatest `order` counts."""
        new = last_wins(rows, order, self.key)
        kept = self.df.join(new.select(self.key), self.key, "left_anti")
        return PointStore(kept.unionByName(new.select(*self.df.columns)), self.key)

    def get(self, id) -> DataFrame:
        """One row, or none."""
        return self.df.where(F.col(self.key) == F.lit(id))

    def exists(self, id) -> bool:
        return not self.get(id).isEmpty()

    def clear(self) -> PointStore:
        return PointStore(self.df.where(F.lit(False)), self.key)

    def count(self) -> int:
        return self.df.count()


def lookup(entries: DataFrame, payload: DataFrame) -> DataFrame:
    """Entries with their payload by id; those without one are left out."""
    return entries.join(payload, "id")


def points_in_boxes(points: DataFrame, boxes: DataFrame, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points with every box (box, x0, y0, x1, y1) that contains them. Boxes are put into all
    cells of a dx by dy grid that they meet, points into one; cells are joined by equality and
    the box is tested on what meets. Cells should be about as large as the boxes."""
    cell = lambda c, o, d: F.floor((c - F.lit(o)) / F.lit(d))
    b = g.B.named("")
    spread = boxes.where(g.is_valid(b)).select(
        "box", "x0", "y0", "x1", "y1",
        F.explode(F.sequence(cell(b.x0, x0, dx), cell(b.x1, x0, dx))).alias("gx"),
    )
    spread = spread.withColumn("gy", F.explode(F.sequence(cell(b.y0, y0, dy), cell(b.y1, y0, dy))))
    placed = points.withColumns({"gx": cell(F.col("x"), x0, dx), "gy": cell(F.col("y"), y0, dy)})
    met = placed.join(spread, ["gx", "gy"]).where(g.contains(b, F.col("x"), F.col("y")))
    return met.drop("gx", "gy", "x0", "y0", "x1", "y1")


def insert(points: PointSet, rows: DataFrame) -> PointSet:
    """With more rows of the same columns; ids have to stay unique."""
    return points.with_df(points.df.unionByName(rows.select(points.df.columns)))
