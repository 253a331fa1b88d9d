"""All registered queries of the point engine, with SQL counterparts where SQL can express them.

Doubles are rounded to six or nine digits on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.functions import vectors as v
from geoquilt.operators import cleaning, layout, models, profile, series, similarity, spatial
from geoquilt.operators.layout import Grid
from geoquilt.schema import Box, PointSet
from geoquilt.sources import binary, files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def r9(c, name: str):
    """For values with few decimals, which end in halves at fewer digits."""
    return F.round(c, 9).alias(name)


# Point sets over the tables

DIMS = 8


def emb(spark, sf) -> PointSet:
    e = lambda i: F.col("embedding")[i].cast("double")
    return PointSet.of(_table(spark, sf, "embeddings"), "vec_id", e(0), e(1), [e(i + 2) for i in range(DIMS)], {"label": "label"})


EMB = (
    "emb AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label, "
    + ", ".join(f"embedding[{i + 3}]::DOUBLE AS f{i}" for i in range(DIMS))
    + " FROM embeddings)"
)


def orders(spark, sf) -> PointSet:
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    price = F.col("o_totalprice")
    labels = {"geo": (F.col("o_custkey") % 65).cast("long"), "attr": "o_orderpriority"}
    return PointSet.of(_table(spark, sf, "orders"), "o_orderkey", price, days, [price / 1e5, days / 1e3], labels)


ORD = """ord AS (SELECT id, x, y, geo, attr, x / 1e5 AS f0, y / 1e3 AS f1 FROM (
  SELECT o_orderkey AS id, o_totalprice AS x, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS y,
         (o_custkey % 65)::BIGINT AS geo, o_orderpriority AS attr FROM orders))"""

EMB_BOX = Box(-0.1, -0.1, 0.1, 0.1)
IN_EMB = "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1"
ORD_BOX = Box(100000.0, 500.0, 200000.0, 1500.0)
IN_ORD = "x BETWEEN 100000 AND 200000 AND y BETWEEN 500 AND 1500"
GRID = Grid(0.0, 0.0, 50000.0, 400.0)
CELL = "concat(floor(x / 50000)::BIGINT, ':', floor(y / 400)::BIGINT)"
REF = 7


def d2_sql(a: str, b: str, n: int = DIMS) -> str:
    return " + ".join(f"({a}f{i} - {b}f{i}) * ({a}f{i} - {b}f{i})" for i in range(n))


# Searches


@query(f"WITH {ORD} SELECT id, x, y FROM ord WHERE {IN_ORD}")
def range_search(spark, sf):
    return spatial.in_box(orders(spark, sf).df, ORD_BOX).select("id", "x", "y")


@query(f"WITH {ORD} SELECT id, x, y FROM ord WHERE x > 100000 AND x < 200000 AND y > 500 AND y < 1500")
def range_open(spark, sf):
    return cleaning.inside_city(orders(spark, sf).df, "x", "y", ORD_BOX).select("id", "x", "y")


@query(
    f"""WITH {ORD} SELECT id, round(d2, 6) AS d2, row_number() OVER (ORDER BY d2, id) AS rank FROM (
    SELECT id, (x - 150000) * (x - 150000) + (y - 1000) * (y - 1000) AS d2 FROM ord ORDER BY d2, id LIMIT 25)"""
)
def knn(spark, sf):
    near = spatial.nearest(orders(spark, sf).df, 150000.0, 1000.0, 25)
    return near.select("id", r6("d2", "d2"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {EMB} SELECT id, round(d2, 6) AS d2, row_number() OVER (ORDER BY d2, id) AS rank FROM (
    SELECT id, x * x + y * y AS d2 FROM emb ORDER BY d2, id LIMIT 10)"""
)
def knn_embeddings(spark, sf):
    near = spatial.nearest(emb(spark, sf).df, 0.0, 0.0, 10)
    return near.select("id", r6("d2", "d2"), F.col("rank").cast("long").alias("rank"))


_LAYOUTS: dict[tuple[str, str], str] = {}


def _layout(spark, sf) -> DataFrame:
    """The orders laid out in cells, written once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LAYOUTS:
        path = files.scratch(spark, "layout")
        layout.save(GRID.assign(orders(spark, sf).df), f"{path}/points")
        layout.cell_stats(layout.load(spark, f"{path}/points")).coalesce(1).write.parquet(f"{path}/cells")
        _LAYOUTS[key] = path
    return layout.load(spark, f"{_LAYOUTS[key]}/points")


def _cells(spark, sf) -> DataFrame:
    _layout(spark, sf)
    return spark.read.parquet(f"{_LAYOUTS[spark.sparkContext.applicationId, sf]}/cells")


@query(_SQL["knn"])
def knn_pruned(spark, sf):
    near = spatial.nearest_pruned(_cells(spark, sf), _layout(spark, sf), 150000.0, 1000.0, 25)
    return near.select("id", r6("d2", "d2"), F.col("rank").cast("long").alias("rank"))


@query(_SQL["range_search"])
def range_search_pruned(spark, sf):
    return GRID.in_box(_layout(spark, sf), ORD_BOX).select("id", "x", "y")


@query(f"WITH {ORD} SELECT count(*) AS n, sum(id)::BIGINT AS ids, round(sum(x), 2) AS x, round(sum(y), 2) AS y FROM ord")
def scan_all(spark, sf):
    return _layout(spark, sf).agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


@query(
    f"""WITH {ORD}, gone AS (SELECT id FROM ord WHERE x BETWEEN 140000 AND 160000 AND y BETWEEN 900 AND 1100 AND id % 2 = 0)
    SELECT id, round(d2, 6) AS d2 FROM (SELECT id, (x - 150000) * (x - 150000) + (y - 1000) * (y - 1000) AS d2
    FROM ord WHERE id NOT IN (SELECT id FROM gone) ORDER BY d2, id LIMIT 25)"""
)
def knn_then_delete(spark, sf):
    points = orders(spark, sf).df
    gone = spatial.in_box(points, Box(140000.0, 900.0, 160000.0, 1100.0)).where("id % 2 = 0")
    return spatial.nearest(spatial.without(points, gone), 150000.0, 1000.0, 25).select("id", r6("d2", "d2"))


@query(
    f"""WITH {ORD}, one AS (SELECT x, y FROM ord ORDER BY id LIMIT 1),
    hit AS (SELECT min(ord.id) AS id FROM ord, one WHERE ord.x = one.x AND ord.y = one.y)
    SELECT count(*) AS left_over, sum(id)::BIGINT AS ids FROM ord WHERE id NOT IN (SELECT id FROM hit)"""
)
def delete_one(spark, sf):
    points = orders(spark, sf).df
    at = points.orderBy("id").limit(1).select("x", "y").first()
    hit = spatial.deletion(points, at["x"], at["y"])
    return spatial.without(points, hit).agg(F.count("*").alias("left_over"), F.sum("id").alias("ids"))


BOXES = """boxes AS (SELECT o_orderkey AS id, (o_orderkey % 97)::INT AS x0, (o_orderkey % 89)::INT AS y0,
  (o_orderkey % 97 + o_custkey % 9)::INT AS x1, (o_orderkey % 89 + o_custkey % 7)::INT AS y1 FROM orders)"""


def _boxes(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sides = {"x0": k % 97, "y0": k % 89, "x1": k % 97 + c % 9, "y1": k % 89 + c % 7}
    return _table(spark, sf, "orders").select(k.alias("id"), *[e.cast("int").alias(n) for n, e in sides.items()])


OPEN = "least(x1, {x1}) > greatest(x0, {x0}) AND least(y1, {y1}) > greatest(y0, {y0})".format(x0=20, y0=20, x1=40, y1=40)


@query(f"WITH {BOXES} SELECT id FROM boxes WHERE {OPEN}")
def find_by_area(spark, sf):
    return spatial.meeting(_boxes(spark, sf), Box(20, 20, 40, 40)).select("id")


@query(f"WITH {BOXES} SELECT id FROM boxes WHERE NOT ({OPEN})")
def delete_area(spark, sf):
    return spatial.not_meeting(_boxes(spark, sf), Box(20, 20, 40, 40)).select("id")


@query(
    f"""WITH {BOXES} SELECT id, ((x1 - x0) * (y1 - y0))::BIGINT AS area, (2 * (x1 - x0 + y1 - y0))::BIGINT AS margin,
    (x1 - x0 + y1 - y0)::BIGINT AS half, (13 BETWEEN x0 AND x1 AND 14 BETWEEN y0 AND y1) AS holds,
    round(pow(greatest(x0 - 13, 0, 13 - x1), 2) + pow(greatest(y0 - 14, 0, 14 - y1), 2), 6) AS d2,
    ((greatest(x1, 40) - least(x0, 20)) * (greatest(y1, 40) - least(y0, 20)) - (x1 - x0) * (y1 - y0))::BIGINT AS growth,
    (pow(trunc((x0 + x1) / 2) - 30, 2) + pow(trunc((y0 + y1) / 2) - 30, 2))::BIGINT AS centre2,
    x0 <= x1 AND y0 <= y1 AS valid FROM boxes"""
)
def box_metrics(spark, sf):
    b, o = g.B.named(""), g.B.of(20, 20, 40, 40)
    long = lambda c, name: c.cast("long").alias(name)
    return _boxes(spark, sf).select(
        "id", long(g.area(b), "area"), long(g.margin(b), "margin"), long(g.half_margin(b), "half"),
        g.contains(b, F.lit(13), F.lit(14)).alias("holds"), r6(g.distance2_to_box(b, F.lit(13), F.lit(14)), "d2"),
        long(g.enlargement(b, o), "growth"), long(g.centre_distance2(b, o), "centre2"), g.is_valid(b).alias("valid"),
    )


STATUS = """st AS (SELECT o_orderpriority || o_orderstatus AS name, min(o_totalprice) AS x0, min(y) AS y0, max(o_totalprice) AS x1,
  max(y) AS y1 FROM (SELECT *, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS y FROM orders) GROUP BY 1)"""


OVERLAPS = """SELECT a.name AS a, b.name AS b,
    round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)), 4) AS shared,
    NOT (a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0) AS touching FROM st a JOIN st b ON a.name < b.name"""


@query(f"WITH {STATUS} {OVERLAPS}")
def box_overlap_pairs(spark, sf):
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    name = F.concat("o_orderpriority", "o_orderstatus").alias("name")
    rows = _table(spark, sf, "orders").select(name, F.col("o_totalprice").alias("x"), days.alias("y"))
    boxes = rows.groupBy("name").agg(*g.box_of())
    a, b = (boxes.toDF(p, *[f"{p}_{s}" for s in ("x0", "y0", "x1", "y1")]) for p in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))  # a box per label: a handful
    one, two = g.B.named("a_"), g.B.named("b_")
    return pairs.select("a", "b", F.round(g.overlap(one, two), 4).alias("shared"), g.intersects(one, two).alias("touching"))


@query(
    """SELECT o_orderkey AS id, (trunc(o_totalprice * 10) - 100)::BIGINT AS x0, (trunc(o_totalprice * 10) + 100)::BIGINT AS x1
    FROM orders"""
)
def geo_integer_boxes(spark, sf):
    b = g.geo_to_integer_box(F.col("o_totalprice"), F.lit(0.0), 10.0, 10)
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), b.x0.cast("long").alias("x0"), b.x1.cast("long").alias("x1"))


@query(f"WITH {ORD} SELECT id, x, y, geo, attr FROM ord WHERE id = {REF}")
def id_lookup(spark, sf):
    return spatial.by_id(orders(spark, sf).df, REF).select("id", "x", "y", "geo", "attr")


@query(
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"""
)
def last_wins(spark, sf):
    rows = _table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return spatial.last_wins(rows, "event_id", "user_id")


@query(
    f"""WITH {ORD}, line AS (SELECT l_orderkey AS id, l_extendedprice AS x, l_discount AS y,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_discount DESC) AS place
        FROM lineitem),
      new AS (SELECT id, x, y FROM line WHERE place = 1)
    SELECT id, x, y FROM ord WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, x, y FROM new"""
)
def store_upsert(spark, sf):
    store = spatial.PointStore(orders(spark, sf).df.select("id", "x", "y"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y")
    )
    return store.upsert(rows, "at").df


REGIONS = """reg AS (SELECT box, x0, y0, x0 + 5000 AS x1, y0 + 50 AS y1 FROM (SELECT c_custkey AS box,
  ((c_custkey * 7919) % 500000)::DOUBLE AS x0, ((c_custkey * 104729) % 2400)::DOUBLE AS y0 FROM customer))"""


@query(f"WITH {ORD}, {REGIONS} SELECT id, box FROM ord JOIN reg ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def points_in_boxes(spark, sf):
    k = F.col("c_custkey")
    boxes = _table(spark, sf, "customer").select(
        k.alias("box"), (k * 7919 % 500000).cast("double").alias("x0"), (k * 104729 % 2400).cast("double").alias("y0")
    )
    boxes = boxes.withColumns({"x1": F.col("x0") + 5000, "y1": F.col("y0") + 50})
    return spatial.points_in_boxes(orders(spark, sf).df, boxes, 5000.0, 50.0).select("id", "box")


@query(f"WITH {ORD} SELECT o.id, o.geo, c.c_mktsegment AS segment FROM ord o JOIN customer c ON c.c_custkey = o.geo")
def payload_lookup(spark, sf):
    payload = _table(spark, sf, "customer").select(F.col("c_custkey").alias("geo"), F.col("c_mktsegment").alias("segment"))
    entries = orders(spark, sf).df.select("id", "geo")
    return entries.join(payload, "geo").select("id", "geo", "segment")


# Similarity


@query(f"WITH {EMB} SELECT label, count(*) AS n FROM emb WHERE {IN_EMB} GROUP BY label HAVING count(*) >= 2")
def groups_in_range(spark, sf):
    return similarity.groups_in_range(emb(spark, sf).df, EMB_BOX)


@query(
    f"""WITH {EMB} SELECT label, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS members
    FROM emb WHERE {IN_EMB} GROUP BY label HAVING count(*) >= 2"""
)
def group_members(spark, sf):
    groups = similarity.groups_in_range(emb(spark, sf).df, EMB_BOX, members=True)
    return groups.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


def _n_similar_sql(ref: int, n: int, box: str) -> str:
    means = ", ".join(f"avg(f{i}) AS f{i}" for i in range(DIMS))
    return f"""WITH {EMB}, r AS (SELECT * FROM emb WHERE id = {ref}),
    c AS (SELECT * FROM emb WHERE {box} AND id <> {ref}),
    m AS (SELECT label, {means} FROM c GROUP BY label),
    k AS (SELECT c.id, c.label, {d2_sql('c.', 'r.')} AS d2, (c.label <> r.label)::INT AS tier,
      CASE WHEN c.label = r.label THEN 0 ELSE {d2_sql('m.', 'r.')} END AS far
      FROM c JOIN m ON m.label = c.label, r)
    SELECT id, label, round(d2, 6) AS d2, row_number() OVER (ORDER BY tier, far, label, d2, id) AS rank
    FROM k ORDER BY rank LIMIT {n}"""


def _n_similar(spark, sf, ref, n, box):
    points = emb(spark, sf)
    out = similarity.n_similar(points, box, similarity.reference(points, ref), n)
    return out.select("id", "label", r6("d2", "d2"), F.col("rank").cast("long").alias("rank"))


@query(_n_similar_sql(REF, 40, IN_EMB))
def n_similar(spark, sf):
    return _n_similar(spark, sf, REF, 40, EMB_BOX)


@query(_n_similar_sql(11, 30, "x BETWEEN 0.05 AND 0.3 AND y BETWEEN -0.3 AND -0.01"))
def n_similar_ref_outside(spark, sf):
    return _n_similar(spark, sf, 11, 30, Box(0.05, -0.3, 0.3, -0.01))


SCORE = "round(exp(-sqrt({d})) * 0.5::DOUBLE + CASE WHEN o.geo = r.geo THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN o.attr = r.attr THEN 0.2::DOUBLE ELSE 0 END, 9)"


@query(
    f"""WITH {ORD}, r AS (SELECT * FROM ord WHERE id = {REF}) SELECT id, round(score, 6) AS score, rank FROM (
    SELECT o.id, {SCORE.format(d=d2_sql('o.', 'r.', 2))} AS score,
      row_number() OVER (ORDER BY {SCORE.format(d=d2_sql('o.', 'r.', 2))} DESC, o.id) AS rank
    FROM ord o, r WHERE o.x BETWEEN 100000 AND 200000 AND o.y BETWEEN 500 AND 1500 AND o.id <> r.id) WHERE rank <= 50"""
)
def legacy_score(spark, sf):
    points = orders(spark, sf)
    out = similarity.legacy_score(points, ORD_BOX, similarity.reference(points, REF), 50)
    return out.select("id", r6("score", "score"), F.col("rank").cast("long").alias("rank"))


TIER = "CASE WHEN o.geo = r.geo AND o.attr = r.attr THEN 1 WHEN o.geo = r.geo THEN 2 ELSE 3 END"


@query(
    f"""WITH {ORD}, r AS (SELECT * FROM ord WHERE id = {REF}), c AS (
    SELECT o.id, {TIER} AS tier, sqrt((o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y)) AS distance FROM ord o, r
    WHERE o.x BETWEEN 100000 AND 200000 AND o.y BETWEEN 500 AND 1500 AND o.id <> r.id ORDER BY tier, o.id LIMIT 50)
    SELECT id, tier, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, id) AS rank FROM c"""
)
def legacy_priority(spark, sf):
    points = orders(spark, sf)
    out = similarity.legacy_priority(points, ORD_BOX, similarity.reference(points, REF), 50)
    return out.select("id", "tier", r6("distance", "distance"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {ORD}, r AS (SELECT * FROM ord WHERE id = {REF}) SELECT o.id, {TIER} AS tier FROM ord o, r
    WHERE o.x BETWEEN 100000 AND 200000 AND o.y BETWEEN 500 AND 1500 AND o.id <> r.id ORDER BY tier, o.id LIMIT 20"""
)
def cluster_priority(spark, sf):
    points = orders(spark, sf)
    return similarity.cluster_priority(points, ORD_BOX, similarity.reference(points, REF), 20)


@query(
    f"""WITH {EMB}, r AS (SELECT * FROM emb WHERE id = {REF}) SELECT e.id, round(exp(-sqrt({d2_sql('e.', 'r.')})), 6) AS similarity
    FROM emb e, r WHERE e.x BETWEEN -0.1 AND 0.1 AND e.y BETWEEN -0.1 AND 0.1 AND exp(-sqrt({d2_sql('e.', 'r.')})) >= 0.6"""
)
def similar_threshold(spark, sf):
    points = emb(spark, sf)
    out = similarity.similar_in_box(points, EMB_BOX, similarity.reference(points, REF), 0.6)
    return out.select("id", r6("similarity", "similarity"))


@query(f"WITH {ORD} SELECT id, geo FROM ord WHERE {IN_ORD} AND attr = '1-URGENT'")
def subcluster_in_box(spark, sf):
    return similarity.subcluster_in_box(orders(spark, sf).df, ORD_BOX, "1-URGENT").select("id", "geo")


@query(
    f"""WITH {EMB}, p AS (SELECT a.id AS a, b.id AS b, round(exp(-sqrt({d2_sql('a.', 'b.')})), 9) AS similarity FROM
    (SELECT * FROM emb WHERE {IN_EMB}) a JOIN (SELECT * FROM emb WHERE {IN_EMB}) b ON a.id < b.id)
    SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM p"""
)
def pair_similarity(spark, sf):
    out = similarity.pair_similarity(emb(spark, sf), EMB_BOX)
    return out.select("a", "b", "similarity", F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT a.vec_id AS id, round(list_distance(a.embedding[1:20]::DOUBLE[], b.embedding[1:20]::DOUBLE[]), 6) AS distance
    FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b"""
)
def vector_distance(spark, sf):
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    one = rows.where("id = 0").select(F.slice("v", 1, 20).alias("o"))
    return rows.join(F.broadcast(one)).select("id", r6(v.array_distance(F.col("v"), F.col("o")), "distance"))


# Cells


@query(f"WITH {ORD} SELECT {CELL} AS cell, count(*) AS n FROM ord GROUP BY 1")
def cell_count(spark, sf):
    return profile.sizes(GRID.assign(orders(spark, sf).df), "cell")


STATS = f"st AS (SELECT {CELL} AS cell, floor(x / 50000)::BIGINT AS gx, floor(y / 400)::BIGINT AS gy, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ord GROUP BY 1, 2, 3)"


@query(f"WITH {ORD}, {STATS} SELECT * FROM st")
def cell_stats(spark, sf):
    return layout.cell_stats(GRID.assign(orders(spark, sf).df))


MEET = "NOT (x1 < 100000 OR x0 > 200000 OR y1 < 500 OR y0 > 1500)"


@query(f"WITH {ORD}, {STATS} SELECT cell, n FROM st WHERE {MEET}")
def leaves_in_range(spark, sf):
    stats = layout.cell_stats(GRID.assign(orders(spark, sf).df))
    return layout.cells_meeting(stats, ORD_BOX).select("cell", "n")


@query(
    f"""WITH {ORD}, {STATS} SELECT cell, round(sqrt(pow(150000 - (x0 + x1) / 2, 2) + pow(1000 - (y0 + y1) / 2, 2)), 4) AS distance
    FROM st ORDER BY sqrt(pow(150000 - (x0 + x1) / 2, 2) + pow(1000 - (y0 + y1) / 2, 2)), cell LIMIT 1"""
)
def nearest_leaf(spark, sf):
    stats = layout.cell_stats(GRID.assign(orders(spark, sf).df))
    return layout.nearest_cell(stats, 150000.0, 1000.0).select("cell", F.round("distance", 4).alias("distance"))


@query(f"WITH {ORD}, {STATS} SELECT cell, n FROM st WHERE gx = 2 AND cell <> '2:2' AND {MEET}")
def sibling_leaves(spark, sf):
    stats = layout.cell_stats(GRID.assign(orders(spark, sf).df))
    return layout.sibling_cells(stats, "2:2", ORD_BOX).select("cell", "n")


@query(
    f"""WITH {ORD} SELECT least(floor((x - 100000) / 1000), 99)::BIGINT AS px, least(floor((y - 500) / 20), 49)::BIGINT AS py,
    count(*) AS n FROM ord WHERE {IN_ORD} GROUP BY 1, 2"""
)
def density_raster(spark, sf):
    return layout.density(orders(spark, sf).df, ORD_BOX, 100, 50)


def _placed(spark, sf) -> PointSet:
    points = orders(spark, sf)
    return points.with_df(GRID.assign(points.df))


@query(f"WITH {ORD} SELECT {CELL} AS cell, attr, count(*) AS n, round(avg(f0), 6) AS f0, round(avg(f1), 6) AS f1 FROM ord GROUP BY 1, 2")
def leaf_groups(spark, sf):
    out = similarity.leaf_groups(_placed(spark, sf), "attr")
    return out.select("cell", "attr", "n", r6("f0", "f0"), r6("f1", "f1"))


@query(f"WITH {ORD} SELECT attr, count(*) AS n, round(avg(f0), 6) AS f0, round(avg(f1), 6) AS f1 FROM ord GROUP BY 1")
def merged_groups(spark, sf):
    out = similarity.merged_means(similarity.leaf_groups(_placed(spark, sf), "attr"), ("f0", "f1"), "attr")
    return out.select("attr", "n", r6("f0", "f0"), r6("f1", "f1"))


@query(
    f"""WITH {ORD}, {STATS} SELECT p.cell, attr, count(*) AS n FROM (SELECT {CELL} AS cell, attr FROM ord) p
    JOIN (SELECT cell FROM st WHERE {MEET}) m ON m.cell = p.cell GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def legacy_groups(spark, sf):
    return similarity.legacy_groups(_placed(spark, sf).df, ORD_BOX)


MICRO = f"""q AS (SELECT {CELL} AS cell, * FROM ord),
  m AS (SELECT cell, geo, attr, count(*) AS n, avg(f0) AS m0, avg(f1) AS m1 FROM q GROUP BY ALL HAVING count(*) >= 2),
  mc AS (SELECT m.cell, m.geo, m.attr, any_value(n) AS n, any_value(m0) AS m0, any_value(m1) AS m1,
    max(sqrt((f0 - m0) * (f0 - m0) + (f1 - m1) * (f1 - m1))) AS radius FROM m JOIN q USING (cell, geo, attr) GROUP BY ALL)"""


@query(f"WITH {ORD}, {MICRO} SELECT cell, geo, attr, n, round(m0, 9) AS m_f0, round(m1, 9) AS m_f1, round(radius, 9) AS radius FROM mc")
def microclusters(spark, sf):
    out = similarity.microclusters(_placed(spark, sf))
    return out.select("cell", "geo", "attr", "n", r9("m_f0", "m_f0"), r9("m_f1", "m_f1"), r9("radius", "radius"))


@query(
    f"""WITH {ORD}, q AS (SELECT {CELL} AS cell, * FROM ord) SELECT cell, geo, attr, count(*) AS n,
    array_to_string(list_sort(list(id))[1:1000], ',') AS members FROM q GROUP BY ALL HAVING count(*) >= 2"""
)
def microcluster_members(spark, sf):
    groups = similarity.capped_members(similarity.microcluster_members(_placed(spark, sf).df))
    return groups.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"WITH {ORD}, {MICRO} SELECT count(*) AS clusters, sum(n)::BIGINT AS points, count(DISTINCT (geo, attr)) AS combinations FROM mc")
def microcluster_stats(spark, sf):
    return similarity.microcluster_stats(similarity.microclusters(_placed(spark, sf)))[0]


@query(f"WITH {ORD}, {MICRO} SELECT geo, attr, count(*) AS cells FROM mc GROUP BY 1, 2 ORDER BY cells DESC, geo, attr LIMIT 10")
def microcluster_top(spark, sf):
    return similarity.microcluster_stats(similarity.microclusters(_placed(spark, sf)))[1]


@query(f"WITH {ORD} SELECT count(*) AS n, count(DISTINCT id) AS ids, sum(id)::BIGINT AS total FROM ord")
def balanced_layout(spark, sf):
    points = orders(spark, sf).df
    placed = layout.Slabs.fit(points, 500).assign(points)
    return placed.where("cell is not null").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("id").alias("total"))


MOST, LEAST = 100, 40
CUTS = f"""pts AS (SELECT * FROM (SELECT id, x, y, {CELL} AS cell, count(*) OVER (PARTITION BY {CELL}) AS held FROM ord) WHERE held > {MOST}),
  cuts AS (SELECT cell, axis, first, 2 * (a_x1 - a_x0 + a_y1 - a_y0) + 2 * (b_x1 - b_x0 + b_y1 - b_y0) AS margin,
    greatest(0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) * greatest(0, least(a_y1, b_y1) - greatest(a_y0, b_y0)) AS shared,
    (a_x1 - a_x0) * (a_y1 - a_y0) + (b_x1 - b_x0) * (b_y1 - b_y0) AS area FROM (
    SELECT cell, axis, held, row_number() OVER h AS first,
      min(x) OVER h AS a_x0, min(y) OVER h AS a_y0, max(x) OVER h AS a_x1, max(y) OVER h AS a_y1,
      min(x) OVER t AS b_x0, min(y) OVER t AS b_y0, max(x) OVER t AS b_x1, max(y) OVER t AS b_y1
    FROM pts, (VALUES (0), (1)) v(axis)
    WINDOW h AS (PARTITION BY cell, axis ORDER BY CASE WHEN axis = 0 THEN x ELSE y END, x, y, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      t AS (PARTITION BY cell, axis ORDER BY CASE WHEN axis = 0 THEN x ELSE y END, x, y, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    WHERE first >= {LEAST} AND first <= held - {LEAST})"""


@query(
    f"""WITH {ORD}, {CUTS}, axes AS (SELECT cell, axis, row_number() OVER (PARTITION BY cell ORDER BY sum(margin), axis) AS place
      FROM cuts GROUP BY cell, axis)
    SELECT cell, axis, first, round(shared, 4) AS shared, round(area, 4) AS area FROM (
      SELECT cuts.*, row_number() OVER (PARTITION BY cell ORDER BY shared, area, first) AS best FROM cuts JOIN axes USING (cell, axis)
      WHERE place = 1) WHERE best = 1"""
)
def best_split(spark, sf):
    cuts = layout.best_splits(GRID.assign(orders(spark, sf).df), MOST, LEAST)
    return cuts.select("cell", "axis", F.col("first").cast("long").alias("first"), F.round("shared", 4).alias("shared"), F.round("area", 4).alias("area"))


#: Cuts of a grid cell, which hold 60 points or fewer unless they are cut so often
DEPTH = 4
_AT = "floor(x / (50000 / {k}))::BIGINT AS gx{l}, floor(y / (400 / {k}))::BIGINT AS gy{l}"
_LEVELS = ", ".join(_AT.format(k=2**k, l=k) for k in range(DEPTH + 1))
_HELD = ", ".join(f"count(*) OVER (PARTITION BY gx{k}, gy{k}) AS n{k}" for k in range(DEPTH + 1))
_LEVEL = " ".join(f"WHEN n{k} <= 60 THEN concat({k}, ':', gx{k}, ':', gy{k})" for k in range(DEPTH))
_OWN = f"CASE {_LEVEL} ELSE concat({DEPTH}, ':', gx{DEPTH}, ':', gy{DEPTH}) END AS cell"


@query(f"WITH {ORD} SELECT id, {_OWN} FROM (SELECT *, {_HELD} FROM (SELECT id, {_LEVELS} FROM ord))")
def refined_cells(spark, sf):
    return layout.refine(orders(spark, sf).df, GRID, 60, DEPTH).select("id", "cell")


@query(f"WITH {ORD} SELECT id, {_OWN} FROM (SELECT *, {_HELD} FROM (SELECT id, {_LEVELS} FROM ord WHERE NOT ({IN_ORD})))")
def condensed_cells(spark, sf):
    left = orders(spark, sf).df.where(~ORD_BOX.contains("x", "y"))
    return layout.refine(left, GRID, 60, DEPTH).select("id", "cell")


@query(
    f"""WITH {ORD}, c AS (SELECT geo, avg(x) AS cx, avg(y) AS cy FROM ord GROUP BY geo)
    SELECT id, ord.geo, round(cx, 6) AS cx, round(cy, 6) AS cy FROM ord LEFT JOIN c ON c.geo = ord.geo"""
)
def centroids_onto_points(spark, sf):
    points = orders(spark, sf).df.select("id", "geo", "x", "y")
    centres = points.groupBy("geo").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return points.join(F.broadcast(centres), "geo", "left").select("id", "geo", r6("cx", "cx"), r6("cy", "cy"))  # 65 rows at most


@query(f"WITH {ORD} SELECT geo, x, y, id FROM ord ORDER BY geo, x, y, id LIMIT 100")
def ordered_head(spark, sf):
    return files.head_copy(orders(spark, sf).df, 100, ["geo", "x", "y", "id"]).select("geo", "x", "y", "id")


@query(
    f"""WITH {ORD} SELECT id, x, y, geo::INT AS geo, 1 AS attr, round(f0, 9) AS f0, round(f1, 9) AS f1 FROM ord"""
)
def binary_roundtrip(spark, sf):
    binary.register(spark)
    path = files.scratch(spark, "points")
    rows = orders(spark, sf).df.select(
        F.col("id").cast("int").alias("id"), "x", "y", F.col("geo").cast("int").alias("geo"), F.lit(1).alias("attr"),
        F.array("f0", "f1").alias("features"),
    )
    rows.write.format("pointfile").option("layout", binary.CLASSIC).mode("append").save(path)
    again = spark.read.format("pointfile").option("layout", binary.CLASSIC).load(path)
    f = F.col("features")
    return again.select(F.col("id").cast("long").alias("id"), "x", "y", "geo", "attr", r9(f[0], "f0"), r9(f[1], "f1"))


@query(f"WITH {ORD} SELECT id, x, y, round(f0, 9) AS f0, round(f1, 9) AS f1 FROM ord")
def binary_plain_roundtrip(spark, sf):
    binary.register(spark)
    path = files.scratch(spark, "plain")
    rows = orders(spark, sf).df.select(F.col("id").cast("int").alias("id"), "x", "y", F.array("f0", "f1").alias("features"))
    rows.write.format("pointfile").option("layout", binary.PLAIN).mode("append").save(path)
    again = spark.read.format("pointfile").option("layout", binary.PLAIN).load(path)
    f = F.col("features")
    return again.select(F.col("id").cast("long").alias("id"), "x", "y", r9(f[0], "f0"), r9(f[1], "f1"))


_CSVS: dict[tuple[str, str], str] = {}


def points_csv(spark, sf) -> str:
    """The orders as point CSV files, written once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CSVS:
        path = files.scratch(spark, "csv")
        rows = orders(spark, sf).df.select(F.col("geo").cast("int"), F.lit(1).alias("attr"), F.col("id").cast("int"), "x", "y", "f0", "f1")
        files.write_csv(rows, path)
        _CSVS[key] = path
    return _CSVS[key]


POINTS = f"WITH {ORD} SELECT id, x, y, geo, round(f0, 9) AS f0, round(f1, 9) AS f1 FROM ord"


@query(POINTS)
def csv_points(spark, sf):
    found = files.read_points_csv(spark, files.first_existing(spark, [points_csv(spark, sf) + "-none", points_csv(spark, sf)]), 2)
    return files.required(found.df, ["id", "x", "y"]).select(
        F.col("id").cast("long").alias("id"), "x", "y", F.col("geo").cast("long").alias("geo"), r9("f0", "f0"), r9("f1", "f1")
    )


@query("SELECT count(*) AS n FROM orders")
def csv_rows(spark, sf):
    return spark.createDataFrame([(files.count_rows(spark, points_csv(spark, sf)),)], "n long")


@query("SELECT least(count(*), 100)::BIGINT AS n, least(count(*), 100)::BIGINT AS ids FROM orders")
def csv_limited(spark, sf):
    some = files.read_points_csv(spark, points_csv(spark, sf), 2, limit=100).df
    return some.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(POINTS)
def csv_to_binary(spark, sf):
    path = files.scratch(spark, "converted")
    binary.convert_csv(spark, points_csv(spark, sf), path, 2)
    again = spark.read.format("pointfile").option("layout", binary.CLASSIC).load(path)
    f = F.col("features")
    return again.select(F.col("id").cast("long").alias("id"), "x", "y", F.col("geo").cast("long").alias("geo"), r9(f[0], "f0"), r9(f[1], "f1"))


@query(f"WITH {ORD} SELECT id, x, y, geo AS label, row_number() OVER (ORDER BY x, y, id) AS place FROM ord")
def sorted_export(spark, sf):
    path = files.scratch(spark, "sorted")
    rows = orders(spark, sf).df.select(F.col("id").cast("int").alias("id"), "x", "y", F.col("geo").cast("int").alias("label"), F.array("f0", "f1").alias("features"))
    binary.sorted_export(rows, path)
    found = spark.read.format("pointfile").option("layout", binary.COMPACT).load(path)
    # files are named in their order, and a file of this size is one task: so ids rise with place
    nth = found.select("*", F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(W.orderBy("at")).cast("long")
    return nth.select(F.col("id").cast("long").alias("id"), "x", "y", F.col("label").cast("long").alias("label"), place.alias("place"))


@query(f"WITH {ORD} SELECT count(*) + 2 AS n, sum(id)::BIGINT + 3000000001 AS ids, count(*) FILTER (x < 0) + 2 AS added FROM ord")
def insert_points(spark, sf):
    points = orders(spark, sf)
    new = spark.createDataFrame([(1500000000, -1.0, -2.0), (1500000001, -3.0, -4.0)], "id long, x double, y double")
    rest = [F.lit(None).cast(t).alias(c) for c, t in points.df.dtypes if c not in ("id", "x", "y")]
    out = spatial.insert(points, new.select("*", *rest)).check_unique().df
    return out.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_if(F.col("x") < 0).alias("added"))


@query(f"WITH {ORD} SELECT {CELL} AS cell, max(CASE WHEN id % 5000 = 7 THEN 2 ELSE 1 END)::BIGINT AS version FROM ord GROUP BY 1")
def cell_versions(spark, sf):
    placed = GRID.assign(orders(spark, sf).df).withColumn("version", F.lit(1))
    changed = layout.versions(placed, placed.where("id % 5000 = 7"), 2)
    return changed.select("cell", F.col("version").cast("long").alias("version"))


@query(
    f"""WITH {BOXES} SELECT id, x0 AS low_x, y0 AS low_y, x1 AS high_x, y1 AS high_y,
    x0 = 20 AND y0 = 20 AND x1 = 24 AND y1 = 22 AS same FROM boxes"""
)
def box_axes(spark, sf):
    b = g.B.named("")
    sides = {"low_x": g.lower(b, 0), "low_y": g.lower(b, 1), "high_x": g.upper(b, 0), "high_y": g.upper(b, 1)}
    return _boxes(spark, sf).select("id", *[c.alias(n) for n, c in sides.items()], g.same(b, g.B.of(20, 20, 24, 22)).alias("same"))


@query(f"WITH {ORD} SELECT id, geo FROM ord WHERE x < 50000 UNION ALL SELECT id, geo FROM ord WHERE {IN_ORD}")
def union_of_boxes(spark, sf):
    rows = orders(spark, sf).df.select("id", "geo", "x", "y")
    return rows.where("x < 50000").unionByName(spatial.in_box(rows, ORD_BOX)).select("id", "geo")


# Cleaning and profiles


@query("SELECT c_custkey AS id, greatest(c_acctbal, 0) AS c_acctbal FROM customer")
def clip_negatives(spark, sf):
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return cleaning.clip_negatives(rows, ["c_acctbal"])


@query(
    """SELECT c_custkey AS id, CASE WHEN low < 0 THEN round(c_acctbal - low, 2) ELSE c_acctbal END AS c_acctbal
    FROM customer, (SELECT least(min(c_acctbal), 0) AS low FROM customer)"""
)
def shift_negatives(spark, sf):
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return cleaning.shift_negatives(rows, ["c_acctbal"])


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 2) AS total
    FROM lineitem"""
)
def recomputed_total(spark, sf):
    rows = cleaning.recomputed_total(_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "total")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "total")


@query(
    """SELECT round(max(off), 4) AS max_off, round(avg(off), 4) AS mean_off, count(*) FILTER (off > 0.01) AS rows_off FROM (
    SELECT abs(l_extendedprice - (l_quantity + l_discount + l_tax)) AS off FROM lineitem)"""
)
def total_check(spark, sf):
    out = profile.total_check(_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select(F.round("max_off", 4).alias("max_off"), F.round("mean_off", 4).alias("mean_off"), "rows_off")


TRIP = """trip AS (SELECT event_id AS id, user_id / 4.0 AS lat, value / 10 AS lon, minutes, miles,
  CASE WHEN minutes = 0 THEN NULL ELSE 60 * miles / minutes END AS mph FROM (
  SELECT event_id, user_id, value, (event_id % 900) * 60 / 60.0 AS minutes, value / 20 AS miles FROM events))"""


def _trips(spark, sf):
    rows = _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") / 4.0).alias("lat"), (F.col("value") / 10).alias("lon"),
        "ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("event_id") % 900 * 60).alias("until"), (F.col("value") / 20).alias("miles"),
    )
    return cleaning.durations(rows, "ts", "until", "miles")


@query(f"WITH {TRIP} SELECT id, round(minutes, 9) AS minutes, round(mph, 9) AS mph, round(CASE WHEN minutes > 0 THEN ln(minutes) END, 9) AS log_minutes FROM trip")
def trip_durations(spark, sf):
    return _trips(spark, sf).select("id", r9("minutes", "minutes"), r9("mph", "mph"), r9(cleaning.log_of("minutes"), "log_minutes"))


KEPT = "lat > 5 AND lat < 30 AND lon > 2 AND lon < 40"


@query(f"WITH {TRIP} SELECT id FROM trip WHERE {KEPT} AND minutes > 1 AND minutes < 720 AND mph > 0 AND mph < 45.31 AND miles > 0 AND miles < 23")
def without_outliers(spark, sf):
    return cleaning.without_outliers(_trips(spark, sf), [("lat", "lon")], "miles", box=Box(5.0, 2.0, 30.0, 40.0)).select("id")


@query("SELECT event_id AS id, value FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def dropped_nulls(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return cleaning.drop_nulls(rows, ["value"])


@query("SELECT event_id AS id, round(CASE WHEN value - 100 > 0 THEN ln(value - 100) END, 9) AS log_value FROM events")
def log_values(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") - 100).alias("v"))
    return rows.select("id", r9(cleaning.log_of("v"), "log_value"))


@query("SELECT c_mktsegment AS segment, c_custkey::INT AS trip, c_acctbal AS amount FROM customer")
def arranged_columns(spark, sf):
    return cleaning.arranged(_table(spark, sf, "customer"), {"segment": "c_mktsegment", "trip": "c_custkey", "amount": "c_acctbal"}, {"trip": "int"})


@query("SELECT p_partkey AS id, round_even(p_size / 8.0::DOUBLE, 2) AS size FROM part")
def rounded_half_even(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 8.0).alias("size"))
    return rows.select("id", cleaning.round_half_even("size", 2).alias("size"))


@query("SELECT least(count(*), 200)::BIGINT AS n, least(count(*), 200)::BIGINT AS ids, true AS again FROM events")
def sampled_rows(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    one, two = cleaning.sample(rows, 200), cleaning.sample(rows.repartition(3), 200)
    out = one.join(two.select("id", F.lit(1).alias("there")), "id", "left")
    return out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), (F.count("there") == F.count("*")).alias("again"))


@query(f"WITH {TRIP} SELECT count(*) AS n, round(avg(mph), 6) AS mph FROM trip WHERE minutes > 1 AND minutes < 720 AND mph > 0 AND mph < 45.31")
def mean_speed(spark, sf):
    rows = _trips(spark, sf).where(cleaning.between_open("minutes", cleaning.MINUTES) & cleaning.between_open("mph", cleaning.SPEED))
    return rows.agg(F.count("*").alias("n"), r6(F.avg("mph"), "mph"))


@query(f"WITH {TRIP} SELECT id FROM trip WHERE NOT ({KEPT})")
def location_outliers(spark, sf):
    return cleaning.location_outliers(_trips(spark, sf), [("lat", "lon")], Box(5.0, 2.0, 30.0, 40.0)).select("id")


@query(
    f"""WITH {TRIP} SELECT (SELECT count(*) FROM trip) AS before, count(*) AS after, round(count(*) / (SELECT count(*) FROM trip), 6) AS share
    FROM trip WHERE {KEPT}"""
)
def kept_share(spark, sf):
    rows = _trips(spark, sf)
    out = profile.kept_share(rows, cleaning.inside_city(rows, "lat", "lon", Box(5.0, 2.0, 30.0, 40.0)))
    return out.select("before", "after", r6("share", "share"))


@query(
    f"""WITH {TRIP} SELECT count(*) AS rows, count(*) FILTER (lat = 0 AND lon = 0) AS null_island, count(*) FILTER (abs(lat) > 90) AS bad_lat,
    count(*) FILTER (abs(lon * 10) > 180) AS bad_lon FROM trip"""
)
def coordinate_report(spark, sf):
    return cleaning.coordinate_report(_trips(spark, sf).withColumn("lon", F.col("lon") * 10), "lat", "lon")


@query("SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal < -100 ORDER BY c_custkey LIMIT 2")
def extreme_rows(spark, sf):
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return cleaning.extremes(rows, "c_acctbal", -100)


def _profile_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean,
    round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std, count(*) FILTER ({c} < 0) AS negatives,
    count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} IS NULL) AS nulls,
    round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_percent FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def column_profile(spark, sf):
    out = profile.column_profile(_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    rounded = {"mean", "median", "std", "null_percent"}
    return out.select(*[r6(c, c) if c in rounded else F.col(c) for c in out.columns])


@query(
    """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
    round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
    max(value) AS max FROM events"""
)
def describe_values(spark, sf):
    out = profile.describe(_table(spark, sf, "events"), "value")
    return out.select("count", r6("mean", "mean"), r6("std", "std"), "min", r6("q25", "q25"), r6("q50", "q50"), r6("q75", "q75"), "max")


@query(
    f"""WITH {ORD} SELECT geo, count(DISTINCT attr) AS subclusters, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max,
    round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM ord GROUP BY geo"""
)
def cluster_meta(spark, sf):
    return profile.cluster_meta(orders(spark, sf).df, "geo", "attr")


@query(f"WITH {ORD} SELECT geo, attr, count(*) AS n FROM ord GROUP BY 1, 2")
def subcluster_sizes(spark, sf):
    return profile.subcluster_sizes(orders(spark, sf).df, "geo", "attr")


@query(f"WITH {ORD}, s AS (SELECT geo, count(*) AS n FROM ord GROUP BY geo) SELECT count(*) AS clusters, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max FROM s")
def cluster_sizes(spark, sf):
    out = profile.size_summary(orders(spark, sf).df, "geo")
    return out.select("clusters", r6("mean", "mean"), "min", "max")


@query(
    f"""WITH {ORD} SELECT count(*) AS n, count(DISTINCT geo) AS clusters, count(DISTINCT (geo, attr)) AS subclusters, min(x) AS x_min,
    max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM ord"""
)
def run_summary(spark, sf):
    return profile.run_summary(orders(spark, sf).df, "geo", "attr")


@query(f"WITH {ORD} SELECT geo = 0 AS outlier, count(*) AS n FROM ord GROUP BY 1")
def split_outliers(spark, sf):
    kept, out = profile.split_outliers(orders(spark, sf).df, "geo", 0)
    both = kept.select(F.lit(False).alias("outlier")).unionByName(out.select(F.lit(True).alias("outlier")))
    return both.groupBy("outlier").agg(F.count("*").alias("n"))


PERCENTS = (0, 10, 50, 90, 95, 99, 99.9, 100)


@query(
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT p.p, s.value FROM s, (SELECT unnest([0, 10, 50, 90, 95, 99, 99.9, 100]::DOUBLE[]) AS p) p
    WHERE s.i = least(floor(s.n * (p.p / 100)), s.n - 1)"""
)
def positional_percentiles(spark, sf):
    return profile.positional_percentiles(_table(spark, sf, "events"), "value", PERCENTS)


@query("SELECT c_custkey AS id, 'a' AS only_in FROM customer WHERE c_acctbal < 0")
def same_ids(spark, sf):
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return profile.same_ids(rows, rows.where("c_acctbal >= 0"))


CENTRES = [(0, -0.2, -0.2), (1, 0.0, 0.0), (2, 0.1, 0.1), (3, 0.2, -0.1)]


@query(
    f"""WITH {EMB}, c AS (SELECT * FROM (VALUES (0, -0.2::DOUBLE, -0.2::DOUBLE), (1, 0, 0), (2, 0.1, 0.1), (3, 0.2, -0.1)) t(centre, cx, cy)),
    d AS (SELECT id, centre, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) AS d, row_number() OVER (PARTITION BY id
      ORDER BY sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)), centre) AS n FROM emb, c)
    SELECT id, CASE WHEN d < 0.1 THEN centre ELSE -1 END AS centre, CASE WHEN d < 0.1 THEN round(d, 6) ELSE -1 END AS distance FROM d WHERE n = 1"""
)
def nearest_center(spark, sf):
    centres = spark.createDataFrame(CENTRES, "centre int, cx double, cy double")
    out = models.nearest_centre(emb(spark, sf).df.select("id", "x", "y"), centres, 0.1)
    return out.select("id", F.coalesce("centre", F.lit(-1)).alias("centre"), r6(F.coalesce("distance", F.lit(-1.0)), "distance"))


HAVERSINE = f"""asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) *
  pow(sin(radians(b.lon - a.lon) / 2), 2)))) * {2 * g.EARTH_METRES / g.MILE_METRES!r}"""


@query(
    f"""WITH c AS (SELECT label AS centre, avg(embedding[1]) AS lat, avg(embedding[2]) AS lon FROM embeddings GROUP BY label),
    p AS (SELECT a.centre, {HAVERSINE} AS d FROM c a JOIN c b ON a.centre <> b.centre)
    SELECT centre, count(*) FILTER (d <= 2) AS within, count(*) FILTER (d > 2) AS beyond, round(min(d), 4) AS nearest FROM p GROUP BY centre"""
)
def center_spacing(spark, sf):
    centres = emb(spark, sf).df.groupBy(F.col("label").alias("centre")).agg(F.avg("x").alias("lat"), F.avg("y").alias("lon"))
    out = models.centre_spacing(centres)
    return out.select("centre", "within", "beyond", F.round("nearest", 4).alias("nearest"))


@query(
    """SELECT p_partkey AS id, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS price,
    round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS size FROM part"""
)
def standardize_sample(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    out = models.standardized(rows, ["price", "size"])
    return out.select("id", r6("price", "price"), r6("size", "size"))


@query(
    """SELECT p_partkey AS id, p_brand AS brand, coalesce(round((p_retailprice - avg(p_retailprice) OVER w) /
    nullif(stddev_pop(p_retailprice) OVER w, 0), 6), 0) AS price FROM part WINDOW w AS (PARTITION BY p_brand)"""
)
def standardize_pop_by_group(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    out = models.standardized(rows, ["price"], by=["brand"], population=True)
    return out.select("id", "brand", r6("price", "price"))


# Series: clusters of users, bins of six hours over thirty days

START, WIDTH, BINS, CLUSTERS = 1704067200, 21600, 120, 4
SER = f"""raw AS (SELECT (user_id % {CLUSTERS})::BIGINT AS cluster, (floor(epoch(ts))::BIGINT - {START}) // {WIDTH} AS bin, value FROM events),
  cnt AS (SELECT cluster, bin, count(value) AS value FROM raw GROUP BY 1, 2),
  ser AS (SELECT c.cluster, b.bin, coalesce(cnt.value, 0) AS value FROM (SELECT DISTINCT cluster FROM cnt) c
    CROSS JOIN (SELECT unnest(range({BINS})) AS bin) b LEFT JOIN cnt ON cnt.cluster = c.cluster AND cnt.bin = b.bin)"""
HALF = BINS // 2
RAT = f"""rat AS (SELECT g.cluster, g.bin, g.value AS given, p.value, coalesce(p.value::DOUBLE / nullif(g.value, 0), 0) AS ratio,
  (dense_rank() OVER (ORDER BY g.cluster) - 1) * {HALF} + g.bin AS i
  FROM (SELECT * FROM ser WHERE bin < {HALF}) g JOIN (SELECT cluster, bin - {HALF} AS bin, value FROM ser WHERE bin >= {HALF}) p
  ON p.cluster = g.cluster AND p.bin = g.bin)"""
NUM = f"num AS (SELECT *, (dense_rank() OVER (ORDER BY cluster) - 1) * {BINS} + bin AS i FROM ser)"


def _counts(spark, sf):
    rows = _table(spark, sf, "events").select(
        (F.col("user_id") % CLUSTERS).cast("long").alias("cluster"),
        series.time_bin(series.unix_seconds("ts"), START, WIDTH, 0).alias("bin"), "value",
    )
    return series.counts(rows, "cluster", "bin", "value")


def _series(spark, sf):
    return series.zero_filled(_counts(spark, sf), BINS)


def _ratios(spark, sf):
    whole = _series(spark, sf)
    later = whole.where(F.col("bin") >= HALF).withColumn("bin", F.col("bin") - HALF)
    return series.ratios(whole.where(F.col("bin") < HALF), later)


@query(f"SELECT event_id AS id, (floor(epoch(ts))::BIGINT - {START}) // 600 + 33 AS bin, floor(epoch(ts))::BIGINT AS seconds FROM events")
def time_bins(spark, sf):
    seconds = series.unix_seconds("ts")
    return _table(spark, sf, "events").select(F.col("event_id").alias("id"), series.time_bin(seconds, START).alias("bin"), seconds.alias("seconds"))


@query(f"WITH {SER} SELECT * FROM cnt")
def pickups_by_bin(spark, sf):
    return _counts(spark, sf)


@query(f"WITH {SER} SELECT cluster, {BINS} - count(DISTINCT bin) AS empty FROM cnt GROUP BY cluster")
def empty_bins(spark, sf):
    return series.empty_bins(_counts(spark, sf), BINS)


@query(f"WITH {SER} SELECT cluster, array_to_string(list_sort(list(DISTINCT bin)), ',') AS bins FROM cnt GROUP BY cluster")
def distinct_bins(spark, sf):
    return series.bins_of(_counts(spark, sf)).withColumn("bins", F.array_join(F.col("bins").cast("array<string>"), ","))


@query(f"WITH {SER} SELECT * FROM ser")
def zero_filled(spark, sf):
    return _series(spark, sf)


@query(
    f"""WITH {SER}, few AS (SELECT * FROM cnt WHERE (cluster * 7 + bin) % 3 <> 0),
    s AS (SELECT c.cluster, b.bin, few.value AS v, max(few.bin) OVER back AS low, min(few.bin) OVER ahead AS high
      FROM (SELECT DISTINCT cluster FROM few) c CROSS JOIN (SELECT unnest(range({BINS})) AS bin) b
      LEFT JOIN few ON few.cluster = c.cluster AND few.bin = b.bin
      WINDOW back AS (PARTITION BY c.cluster ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS (PARTITION BY c.cluster ORDER BY b.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT s.cluster, s.bin, coalesce(s.v, trunc((coalesce(l.value, 0) + coalesce(h.value, 0)) /
      (coalesce(s.high, {BINS - 1}) - coalesce(s.low, 0) + 1))::BIGINT) AS value
    FROM s LEFT JOIN few l ON l.cluster = s.cluster AND l.bin = s.low LEFT JOIN few h ON h.cluster = s.cluster AND h.bin = s.high"""
)
def smoothed(spark, sf):
    some = _counts(spark, sf).where("(cluster * 7 + bin) % 3 <> 0")
    return series.smoothed(some, BINS)


@query(f"WITH {SER}, {RAT} SELECT cluster, bin, given, value, round(ratio, 6) AS ratio FROM rat")
def series_ratios(spark, sf):
    return _ratios(spark, sf).select("cluster", "bin", "given", "value", r6("ratio", "ratio"))


@query(
    f"""WITH {SER} SELECT cluster, bin, value, lag(value, 5, -1) OVER w AS ft_5, lag(value, 4, -1) OVER w AS ft_4, lag(value, 3, -1) OVER w AS ft_3,
    lag(value, 2, -1) OVER w AS ft_2, lag(value, 1, -1) OVER w AS ft_1 FROM ser WINDOW w AS (PARTITION BY cluster ORDER BY bin)"""
)
def lag_features(spark, sf):
    return series.lags(_series(spark, sf)).na.fill(-1, [f"ft_{k}" for k in range(1, 6)])


MA = f"""ma AS (SELECT *, CASE WHEN i % {HALF} = 0 THEN 0 WHEN i % {HALF} = 1 AND i > 1
  THEN avg(ratio) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING)
  ELSE avg(ratio) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS r FROM rat)"""


@query(f"WITH {SER}, {RAT}, {MA} SELECT cluster, bin, trunc(given * r + 1e-9)::BIGINT AS predicted FROM ma")
def ma_ratio(spark, sf):
    out = series.mean_of_ratios(_ratios(spark, sf), HALF)
    return out.select("cluster", "bin", (F.col("given") * F.col("r") + 1e-9).cast("long").alias("predicted"))


@query(f"WITH {SER}, {NUM} SELECT cluster, bin, coalesce(lag(value) OVER (ORDER BY i), value)::BIGINT AS predicted FROM num")
def ma_value(spark, sf):
    return series.mean_of_values(_series(spark, sf), BINS).select("cluster", "bin", "predicted")


@query(
    f"""WITH {SER}, {NUM} SELECT cluster, bin, coalesce(trunc((2 * lag(value, 1) OVER w + lag(value, 2) OVER w) / 3)::BIGINT,
    lag(value, 1) OVER w, value)::BIGINT AS predicted FROM num WINDOW w AS (ORDER BY i)"""
)
def wma_value(spark, sf):
    return series.weighted_values(_series(spark, sf), BINS).select("cluster", "bin", "predicted")


@query(
    f"""WITH {SER}, {RAT} SELECT cluster, bin, CASE WHEN i % {HALF} = 0 THEN 0 ELSE trunc(given * coalesce((2 * lag(ratio, 1) OVER w +
    lag(ratio, 2) OVER w) / 3, lag(ratio, 1) OVER w) + 1e-9)::BIGINT END AS predicted FROM rat WINDOW w AS (ORDER BY i)"""
)
def wma_ratio(spark, sf):
    out = series.weighted_ratios(_ratios(spark, sf), HALF)
    return out.select("cluster", "bin", (F.col("given") * F.col("r") + 1e-9).cast("long").alias("predicted"))


EWMA_R = f"""WITH RECURSIVE {SER}, {RAT}, e AS (
  SELECT i, cluster, bin, given, value, ratio AS r, 0::BIGINT AS predicted FROM rat WHERE i = 0
  UNION ALL
  SELECT n.i, n.cluster, n.bin, n.given, n.value, CASE WHEN n.i % {HALF} = 0 THEN e.r ELSE e.r * 0.6::DOUBLE + n.ratio * 0.4::DOUBLE END,
    CASE WHEN n.i % {HALF} = 0 THEN 0 ELSE trunc(n.given * e.r)::BIGINT END
  FROM e JOIN rat n ON n.i = e.i + 1)"""
EWMA_V = f"""WITH RECURSIVE {SER}, {NUM}, e AS (
  SELECT i, cluster, bin, value, value::BIGINT AS r, 0::BIGINT AS predicted FROM num WHERE i = 0
  UNION ALL
  SELECT n.i, n.cluster, n.bin, n.value, CASE WHEN n.i % {BINS} = 0 THEN e.r ELSE trunc(e.r * 0.3::DOUBLE + n.value * 0.7::DOUBLE)::BIGINT END,
    CASE WHEN n.i % {BINS} = 0 THEN 0 ELSE e.r END
  FROM e JOIN num n ON n.i = e.i + 1)"""


@query(f"{EWMA_R} SELECT cluster, bin, predicted FROM e")
def ewma_ratio(spark, sf):
    return series.exponential_ratios(_ratios(spark, sf), HALF).select("cluster", "bin", "predicted")


@query(f"{EWMA_V} SELECT cluster, bin, predicted FROM e")
def ewma_value(spark, sf):
    return series.exponential_values(_series(spark, sf), BINS).select("cluster", "bin", "predicted")


@query(
    f"""{EWMA_V} SELECT round(avg(err) / avg(value), 6) AS mape, round(avg(err * err), 6) AS mse FROM (
    SELECT value, CASE WHEN i % {BINS} = 0 THEN 0 ELSE abs(predicted - value) END::DOUBLE AS err FROM e)"""
)
def forecast_error(spark, sf):
    out = series.forecast_error(series.exponential_values(_series(spark, sf), BINS))
    return out.select(r6("mape", "mape"), r6("mse", "mse"))


@query(f"WITH {SER} SELECT cluster, bin, ((bin // 4) % 7 + 4) % 7 AS weekday FROM ser")
def weekday(spark, sf):
    return _series(spark, sf).select("cluster", "bin", series.weekday("bin", 4).alias("weekday"))


@query(
    f"""WITH {SER} SELECT cluster, bin, CASE WHEN row_number() OVER (PARTITION BY cluster ORDER BY bin) <=
    floor(0.7::DOUBLE * count(*) OVER (PARTITION BY cluster)) THEN 'train' ELSE 'test' END AS part FROM ser"""
)
def time_split(spark, sf):
    return series.time_split(_series(spark, sf)).select("cluster", "bin", "part")


@query(
    f"""WITH {SER}, n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM ser WINDOW w AS (PARTITION BY cluster ORDER BY bin))
    SELECT cluster, bin, value FROM n WHERE value > 5 AND value > b AND value > a"""
)
def series_peaks(spark, sf):
    return series.peaks(_series(spark, sf), 5)


EXP = """e AS (SELECT cluster, bin, value, value::BIGINT AS r, 0::BIGINT AS predicted FROM ser WHERE bin = 0
  UNION ALL SELECT n.cluster, n.bin, n.value, trunc(e.r * 0.3::DOUBLE + n.value * 0.7::DOUBLE)::BIGINT, e.r
  FROM e JOIN ser n ON n.cluster = e.cluster AND n.bin = e.bin + 1)"""


@query(
    f"""WITH RECURSIVE {SER}, {EXP}, w AS (SELECT cluster, bin, value, predicted AS exp_avg, lag(value, 5) OVER o AS ft_5, lag(value, 4) OVER o AS ft_4,
    lag(value, 3) OVER o AS ft_3, lag(value, 2) OVER o AS ft_2, lag(value, 1) OVER o AS ft_1, ((bin // 4) % 7 + 4) % 7 AS weekday
    FROM e WINDOW o AS (PARTITION BY cluster ORDER BY bin)) SELECT * FROM w WHERE ft_5 IS NOT NULL"""
)
def training_frame(spark, sf):
    frame = series.training_frame(_series(spark, sf), _places(spark), BINS, 4).na.fill(-1)
    return frame.select("cluster", "bin", "value", "exp_avg", "ft_5", "ft_4", "ft_3", "ft_2", "ft_1", "weekday")


@query(
    f"""WITH {SER}, d AS (SELECT cluster, k, sqrt(pow(sum(value * cos(2 * pi() * k * bin / {BINS})), 2) + pow(sum(value * sin(2 * pi() * k * bin / {BINS})), 2)) AS p
      FROM ser, (SELECT unnest(range({BINS // 2 + 1})) AS k) GROUP BY 1, 2),
    m AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS a FROM d WINDOW w AS (PARTITION BY cluster ORDER BY k)),
    q AS (SELECT cluster, k, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, k) AS n FROM m WHERE p > b AND p > a)
    SELECT cluster, count(*) AS n_peaks, """
    + ", ".join(f"round(coalesce(max(k) FILTER (n = {i + 1}), 0) / {BINS}.0::DOUBLE, 9) AS f_{i}" for i in (0, 2, 4))
    + " FROM q GROUP BY cluster"
)
def fft_features(spark, sf):
    out = series.spectrum_features(_series(spark, sf))
    return out.select("cluster", "n_peaks", r9("f_0", "f_0"), r9("f_2", "f_2"), r9("f_4", "f_4"))


#: Components of two features, whose covariance matrix has roots in closed form.
PLANE = f"""{ORD}, v AS (SELECT var_samp(f0) AS a, covar_samp(f0, f1) AS b, var_samp(f1) AS c FROM ord),
  l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS one, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS two FROM v),
  u AS (SELECT *, one / (one + two) AS share, CASE WHEN a >= c THEN (one - c) ELSE abs(b) END / sqrt(pow(CASE WHEN a >= c THEN one - c ELSE abs(b) END, 2) +
    pow(CASE WHEN a >= c THEN b ELSE one - a END, 2)) AS p, CASE WHEN a >= c THEN b ELSE (one - a) * CASE WHEN b < 0 THEN -1 ELSE 1 END END /
    sqrt(pow(CASE WHEN a >= c THEN one - c ELSE abs(b) END, 2) + pow(CASE WHEN a >= c THEN b ELSE one - a END, 2)) AS q FROM l)"""


def _plane(spark, sf):
    return models.components(orders(spark, sf).df.select("id", "f0", "f1"), ["f0", "f1"], k=2)


@query(f"WITH {PLANE} SELECT id, round(f0 * p + f1 * q, 4) + 0.0::DOUBLE AS pc1, round(f1 * p - f0 * q, 4) + 0.0::DOUBLE AS pc2 FROM ord, u")
def pca_plane(spark, sf):
    return _plane(spark, sf)[0].select("id", (F.round("PC1", 4) + 0.0).alias("pc1"), (F.round("PC2", 4) + 0.0).alias("pc2"))


@query(f"WITH {PLANE} SELECT 1::BIGINT AS component, round(share, 6) AS share, round(share, 6) AS upto FROM u UNION ALL SELECT 2, round(1 - share, 6), 1.0 FROM u")
def explained_variance(spark, sf):
    rows = models.explained_variance([float(x) for x in _plane(spark, sf)[1]])
    return spark.createDataFrame([(n, round(s, 6), round(t, 6)) for n, s, t in rows], "component long, share double, upto double")


# Trained models and transforms, and queries of what has to hold for them


@query(f"WITH {EMB} SELECT count(*) AS n, 8::BIGINT AS clusters, 0::BIGINT AS misplaced, true AS same_cost FROM emb")
def kmeans_invariants(spark, sf):
    """Every point has the label of its nearest centre; the cost, which is that before the last
    move of the centres, is about the sum of the squares."""
    points = emb(spark, sf).df.select("id", "x", "y")
    found, centres, cost = models.clusters(points, ["x", "y"], 8)
    table = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "centre int, cx double, cy double")
    near = models.nearest_centre(found, table, 1e9)
    return near.agg(
        F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster") != F.col("centre")).alias("misplaced"),
        (F.abs(F.sum(F.col("distance") * F.col("distance")) - F.lit(cost)) < 0.01 * cost).alias("same_cost"),
    )


@query(
    f"""WITH {EMB}, d AS (SELECT sqrt(x * x + y * y) AS a, sqrt((x - 0.1) * (x - 0.1) + (y - 0.1) * (y - 0.1)) AS b FROM emb)
    SELECT CASE WHEN least(a, b) >= 0.05 THEN 'rest' WHEN a <= b THEN '0' ELSE '1' END AS part, count(*) AS n FROM d GROUP BY 1"""
)
def fixed_centre_sizes(spark, sf):
    points = emb(spark, sf).df.select("id", "x", "y")
    out = models.clusters_with_fixed(points, [(0.0, 0.0), (0.1, 0.1)], 4, 0.05)
    part = F.when(F.col("cluster") >= 2, "rest").otherwise(F.col("cluster").cast("string"))
    return out.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def _subcluster_sizes(spark, sf, columns):
    out = models.subclusters(emb(spark, sf).df, "label", columns, 5)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("subcluster").alias("subclusters"))


@query(f"WITH {EMB} SELECT label, count(*) AS n, 5::BIGINT AS subclusters FROM emb GROUP BY label")
def attribute_subcluster_sizes(spark, sf):
    return _subcluster_sizes(spark, sf, [f"f{i}" for i in range(DIMS)])


@query(f"WITH {EMB} SELECT label, count(*) AS n, 5::BIGINT AS subclusters FROM emb GROUP BY label")
def geographic_subcluster_sizes(spark, sf):
    return _subcluster_sizes(spark, sf, ["x", "y"])


@query("SELECT unnest([2, 4, 8])::BIGINT AS k, true AS closer")
def spacing_sweep(spark, sf):
    """Of more clusters the centres are no further apart."""
    rows = models.spacing_sweep(emb(spark, sf).df, [2, 4, 8])
    least = [d for _, _, d in rows]
    return spark.createDataFrame([(k, i == 0 or d <= least[0]) for i, (k, _, d) in enumerate(rows)], "k long, closer boolean")


@query()
def pca(spark, sf):
    points = emb(spark, sf)
    scaled = models.standardized(points.df, points.features, population=True)
    return models.components(scaled, points.features, share=0.9)[0].drop(*points.features)


@query()
def kmeans_labels(spark, sf):
    points = emb(spark, sf)
    return models.clusters(points.df, ["x", "y"], 8)[0].select("id", "cluster")


@query()
def fixed_centre_clusters(spark, sf):
    points = emb(spark, sf).df.select("id", "x", "y")
    return models.clusters_with_fixed(points, [(0.0, 0.0), (0.1, 0.1)], 4, 0.05)


@query()
def attribute_subclusters(spark, sf):
    points = emb(spark, sf)
    return models.subclusters(points.df, "label", points.features, 5).select("id", "label", "subcluster")


@query()
def best_k(spark, sf):
    points = emb(spark, sf)
    k, scores = models.best_k(points.df, points.features)
    return spark.createDataFrame([(i, float(s), i == k) for i, s in scores.items()], "k int, silhouette double, chosen boolean")


@query()
def best_k_by_zone(spark, sf):
    points = emb(spark, sf)
    return models.best_k_by_group(points.df, "label", points.features, per=50)


def _places(spark):
    return spark.range(CLUSTERS).select(F.col("id").alias("cluster"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))


def _forecast(spark, sf, kind):
    frame = series.time_split(series.training_frame(_series(spark, sf), _places(spark), BINS, 4)).cache()
    columns = ["ft_5", "ft_4", "ft_3", "ft_2", "ft_1", "weekday", "exp_avg"]
    out = models.forecasts(frame.where("part = 'train'"), frame.where("part = 'test'"), columns, kind=kind)
    return out.select("cluster", "bin", "value", "predicted", "error")


@query()
def linear_forecast(spark, sf):
    return _forecast(spark, sf, "linear")


@query()
def forest_forecast(spark, sf):
    return _forecast(spark, sf, "forest")


@query()
def gbt_forecast(spark, sf):
    return _forecast(spark, sf, "boosted")
