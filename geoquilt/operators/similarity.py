"""Similar points and groups inside a box: the two headline queries, and their older variants.

Ties are settled by id everywhere. The reference point of a query may lie outside the box and
is never in its own result; it comes as a one-row DataFrame, so that the query stays one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.functions import vectors as v
from geoquilt.operators import layout
from geoquilt.operators.sides import few
from geoquilt.operators.spatial import in_box
from geoquilt.schema import Box, PointSet

#: Points of a box up to which one side of all pairs is broadcast.
MOST_PAIRED = 20_000
#: Points of a block beyond that: a task forms the pairs of two blocks.
PAIR_BLOCK = 5_000


def reference(points: PointSet, id) -> DataFrame:
    """The point of an id, with its columns under r_: one row or none."""
    row = points.df.where(F.col("id") == F.lit(id)).limit(1)
    keep = ["id", "x", "y", *points.labels, *points.features]
    return row.select(*[F.col(c).alias(f"r_{c}") for c in keep])


def _candidates(points: PointSet, box: Box, ref: DataFrame) -> DataFrame:
    rows = in_box(points.df, box).join(F.broadcast(ref))  # one row
    return rows.where(F.col("id") != F.col("r_id"))


def _d2(points: PointSet, prefix: str = "r_"):
    return v.distance2([F.col(f) for f in points.features], [F.col(f"{prefix}{f}") for f in points.features])


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # after a limit


def n_similar(points: PointSet, box: Box, ref: DataFrame, n: int, label: str = "label") -> DataFrame:
    """The n points of the box most similar to the reference: first those of its label by
    distance, then label by label, in the order of the distance of the label's mean over the
    box, each by distance. (id, label, d2, rank); n <= 0 gives none."""
    rows = _candidates(points, box, ref).withColumn("d2", _d2(points))
    means = in_box(points.df, box).join(F.broadcast(ref.select("r_id"))).where("id <> r_id")
    means = means.groupBy(F.col(label).alias("m_label")).agg(*[F.avg(f).alias(f"m_{f}") for f in points.features])
    joined = rows.join(few(means), F.col(label) == F.col("m_label"))
    far = v.distance2([F.col(f"m_{f}") for f in points.features], [F.col(f"r_{f}") for f in points.features])
    own = F.col(label) == F.col(f"r_{label}")
    keyed = joined.select(
        "id", F.col(label).alias("label"), "d2",
        F.when(own, 0).otherwise(1).alias("tier"), F.when(own, 0.0).otherwise(far).alias("far"),
    )
    order = ("tier", "far", "label", "d2", "id")
    return _ranked(keyed.orderBy(*order).limit(max(n, 0)), *order).select("id", "label", "d2", "rank")


def groups_in_range(points: DataFrame, box: Box, label: str = "label", members: bool = False, least: int = 2) -> DataFrame:
    """(label, n) of labels with `least` points or more in the box; on request with their ids."""
    aggs = [F.count("*").alias("n")]
    if members:
        aggs.append(F.sort_array(F.collect_list("id")).alias("members"))
    return in_box(points, box).groupBy(label).agg(*aggs).where(F.col("n") >= least)


def capped_members(groups: DataFrame, most: int = 1000) -> DataFrame:
    """Groups with their first `most` members."""
    return groups.withColumn("members", F.slice("members", 1, most))


# Older variants, by two labels


def _tiers(geo: str, attr: str):
    same_geo, same_attr = F.col(geo) == F.col(f"r_{geo}"), F.col(attr) == F.col(f"r_{attr}")
    return same_geo, same_attr, F.when(same_geo & same_attr, 1).when(same_geo, 2).otherwise(3)


def legacy_score(points: PointSet, box: Box, ref: DataFrame, n: int, geo: str = "geo", attr: str = "attr") -> DataFrame:
    """The n of the highest 0.5 exp(-distance) + 0.3 [same geo] + 0.2 [same attr]."""
    same_geo, same_attr, _ = _tiers(geo, attr)
    near = v.similarity([F.col(f) for f in points.features], [F.col(f"r_{f}") for f in points.features], len(points.features))
    score = near * 0.5 + F.when(same_geo, 0.3).otherwise(0.0) + F.when(same_attr, 0.2).otherwise(0.0)
    rows = _candidates(points, box, ref).select("id", F.round(score, 9).alias("score"))
    order = (F.desc("score"), "id")
    return _ranked(rows.orderBy(*order).limit(max(n, 0)), *order)


def legacy_priority(points: PointSet, box: Box, ref: DataFrame, n: int, geo: str = "geo", attr: str = "attr") -> DataFrame:
    """The first n by tier (both labels, geo alone, neither) and id, then by planar distance."""
    rows = _candidates(points, box, ref)
    distance = g.planar_distance(F.col("r_x"), F.col("r_y"), F.col("x"), F.col("y"))
    cut = rows.select("id", _tiers(geo, attr)[2].alias("tier"), distance.alias("distance"))
    return _ranked(cut.orderBy("tier", "id").limit(max(n, 0)), "distance", "id")


def cluster_priority(points: PointSet, box: Box, ref: DataFrame, n: int, geo: str = "geo", attr: str = "attr") -> DataFrame:
    """The first n by tier and id, without a score."""
    rows = _candidates(points, box, ref).select("id", _tiers(geo, attr)[2].alias("tier"))
    return rows.orderBy("tier", "id").limit(max(n, 0))


def similar_in_box(points: PointSet, box: Box, ref: DataFrame, threshold: float) -> DataFrame:
    """(id, similarity) of at least a threshold; the reference itself counts."""
    near = v.similarity([F.col(f) for f in points.features], [F.col(f"r_{f}") for f in points.features])
    rows = in_box(points.df, box).join(F.broadcast(ref)).select("id", near.alias("similarity"))
    return rows.where(F.col("similarity") >= threshold)


def subcluster_in_box(points: DataFrame, box: Box, attr, name: str = "attr") -> DataFrame:
    """Points of the box with an attribute label, of any geographic one."""
    return in_box(points, box).where(F.col(name) == F.lit(attr))


def pair_similarity(points: PointSet, box: Box, most: int | None = None) -> DataFrame:
    """(a, b, similarity, rank of b for a) of all pairs a < b in a box. Their number is the square
    of the points': a caller may give a bound of these. Up to MOST_PAIRED points one side is
    broadcast; of more, pairs are formed by blocks of about PAIR_BLOCK points."""
    rows = in_box(points.df, box)
    n = rows.count()
    if most is not None and n > most:
        raise ValueError(f"the box holds {n} points; pairs are formed of {most} at most")
    left = rows.select(F.col("id").alias("a"), *[F.col(f).alias(f"a_{f}") for f in points.features])
    right = rows.select(F.col("id").alias("b"), *[F.col(f).alias(f"b_{f}") for f in points.features])
    near = v.similarity([F.col(f"a_{f}") for f in points.features], [F.col(f"b_{f}") for f in points.features])
    if n <= MOST_PAIRED:
        both = left.join(F.broadcast(right), F.col("a") < F.col("b"))
    else:  # each pair of blocks meets once, under a key of its own
        blocks = -(-n // PAIR_BLOCK)
        other = F.sequence(F.lit(0), F.lit(blocks - 1))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        left = left.withColumn("i", block("a")).withColumn("j", F.explode(other))
        right = right.withColumn("j", block("b")).withColumn("i", F.explode(other))
        both = left.join(right.hint("shuffle_merge"), ["i", "j"]).where("a < b")
    pairs = both.select("a", "b", F.round(near, 9).alias("similarity"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b")))


# Cells


def leaf_groups(placed: PointSet, label: str = "label") -> DataFrame:
    """(cell, label, n, mean features): the summary that a layout keeps."""
    return placed.df.groupBy("cell", label).agg(F.count("*").alias("n"), *v.mean_vector(placed.features))


def refreshed(summary: DataFrame, placed: PointSet, changed: DataFrame, label: str = "label") -> DataFrame:
    """The summary after a change: only cells named in `changed` (cell) are computed anew."""
    touched = changed.select("cell").distinct()
    again = placed.with_df(placed.df.join(touched, "cell", "left_semi"))
    return summary.join(touched, "cell", "left_anti").unionByName(leaf_groups(again, label))


def legacy_groups(placed: DataFrame, box: Box, attr: str = "attr", least: int = 2) -> DataFrame:
    """(cell, attr, n) over all points of the cells that meet the box, in it or not."""
    cells = layout.cells_meeting(layout.cell_stats(placed), box).select("cell")
    rows = placed.join(cells, "cell", "left_semi")
    return rows.groupBy("cell", attr).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def microclusters(placed: PointSet, geo: str = "geo", attr: str = "attr", least: int = 2) -> DataFrame:
    """(cell, geo, attr, n, mean features, radius): groups of a cell with two points or more; the
    radius is the largest distance of a member to the mean."""
    key = ["cell", geo, attr]
    means = placed.df.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in placed.features])
    means = means.where(F.col("n") >= least)
    joined = placed.df.join(means, key)
    far = F.sqrt(v.distance2([F.col(f) for f in placed.features], [F.col(f"m_{f}") for f in placed.features]))
    same = [F.any_value(c).alias(c) for c in ("n", *(f"m_{f}" for f in placed.features))]
    return joined.groupBy(*key).agg(*same, F.max(far).alias("radius"))


def microcluster_members(placed: DataFrame, geo: str = "geo", attr: str = "attr", least: int = 2) -> DataFrame:
    """(cell, geo, attr, n, members): the microclusters with all their ids."""
    groups = placed.groupBy("cell", geo, attr).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"))
    return groups.where(F.col("n") >= least)


def microcluster_stats(clusters: DataFrame, geo: str = "geo", attr: str = "attr", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row: clusters, points, combinations) and the `top` label pairs by cells."""
    total = clusters.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("points"), F.count_distinct(geo, attr).alias("combinations")
    )
    pairs = clusters.groupBy(geo, attr).agg(F.count("*").alias("cells"))
    return total, pairs.orderBy(F.desc("cells"), geo, attr).limit(top)


def merged_means(summary: DataFrame, features, label: str = "label") -> DataFrame:
    """(label, n, mean features) from a summary per cell: weighted, without reading points."""
    weighted = [(F.sum(F.col(f) * F.col("n")) / F.sum("n")).alias(f) for f in features]
    return summary.groupBy(label).agg(F.sum("n").alias("n"), *weighted)
