"""Hand-made cases: geometry, searches, deletions, groups, similar points."""

import math

import pytest
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.functions import vectors as v
from geoquilt.operators import layout, similarity, spatial
from geoquilt.plans import catalog
from geoquilt.schema import Box, PointSet


def points(spark, rows, features=0, labels=("label",)):
    names = ["id", "x", "y", *labels, *[f"f{i}" for i in range(features)]]
    kinds = ["long", "double", "double", *["int"] * len(labels), *["double"] * features]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return PointSet(df, tuple(f"f{i}" for i in range(features)), tuple(labels))


def grid500(spark):
    return spark.createDataFrame([(i * 20 + j, 0.01 * i, 0.01 * j) for i in range(25) for j in range(20)], "id long, x double, y double")


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_boxes(spark):
    a, b, c = g.B.of(0, 0, 10, 10), g.B.of(5, 5, 15, 15), g.B.of(20, 20, 30, 30)
    row = one(
        spark, g.area(a), g.margin(a), g.overlap(a, b), g.overlap(a, c), g.intersects(a, b), g.intersects(a, c),
        g.distance2_to_box(a, F.lit(13), F.lit(14)), g.distance2_to_box(a, F.lit(5), F.lit(5)), g.enlargement(a, b), g.same(a, a), g.same(a, b),
    )
    assert tuple(row) == (100, 40, 25, 0, True, False, 25.0, 0.0, 125, True, False)
    touching = g.B.of(10, 0, 20, 10)
    assert tuple(one(spark, g.intersects(a, touching), g.intersects_open(a, touching))) == (True, False)
    assert tuple(one(spark, g.is_valid(g.B.of(None, None, None, None)), g.lower(b, 1), g.upper(b, 0))) == (False, 5, 15)
    assert Box().empty and Box(0, 0, 1, 1).stretched(Box()).x1 == 1
    with pytest.raises(ValueError):
        Box(1.0)


def test_integer_boxes_and_centres(spark):
    b = g.geo_to_integer_box(F.lit(40.7123456), F.lit(-74.0), 0.001)
    assert tuple(one(spark, b.x0, b.x1, b.y0)) == (40711345, 40713345, -74001000)
    assert one(spark, g.centre_distance2(g.B.of(0, 0, 3, 3), g.B.of(10, 10, 13, 13)))[0] == 200


def test_sphere(spark):
    miles = one(spark, g.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert miles == pytest.approx(math.radians(1) * g.EARTH_METRES / g.MILE_METRES)


def test_range_keeps_every_point_once_and_id_zero(spark):
    rows = spatial.in_box(grid500(spark), Box(-1, -1, 1, 1)).select("id").collect()
    assert sorted(r.id for r in rows) == list(range(500))
    few = points(spark, [(0, 1.0, 1.0, 0)] + [(i, 1 + 0.001 * i, 1.0, 0) for i in range(1, 6)]).df
    assert 0 in {r.id for r in spatial.in_box(few, Box(0.9, 0.9, 1.1, 1.1)).collect()}
    assert spatial.in_box(few, Box()).count() == 0
    far = points(spark, [(i, 0.001 * i, 0.001 * i, 0) for i in range(9)] + [(100, 5.0, 5.0, 0)]).df
    assert [r.id for r in spatial.in_box(far, Box(4.9, 4.9, 5.1, 5.1)).collect()] == [100]


def lcg(n, seed=12345):
    s, out = seed, []
    for _ in range(2 * n):
        s = (s * 1103515245 + 12345) % 2**32
        out.append(((s >> 8) % 100000) / 100000)
    return [(i, out[2 * i], out[2 * i + 1]) for i in range(n)]


@pytest.mark.parametrize("k", [10, 0, -3, 999])
def test_nearest_equals_brute_force(spark, k):
    rows = lcg(300)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    want = sorted(rows, key=lambda r: ((r[1] - 0.5) ** 2 + (r[2] - 0.5) ** 2, r[0]))[: max(k, 0)]
    got = spatial.nearest(df, 0.5, 0.5, k).orderBy("rank").collect()
    assert [r.id for r in got] == [r[0] for r in want]
    placed = layout.Grid(0, 0, 0.1, 0.1).assign(df)
    pruned = spatial.nearest_pruned(layout.cell_stats(placed), placed, 0.5, 0.5, k).orderBy("rank").collect()
    assert [r.id for r in pruned] == [r[0] for r in want]


def test_deletions(spark):
    df = grid500(spark)
    gone = df.where("id < 200")
    assert spatial.without(df, gone).count() == 300
    assert spatial.deletion(df, 9.9, 9.9).count() == 0
    twins = spark.createDataFrame([(4, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 2.0)], "id long, x double, y double")
    assert [r.id for r in spatial.deletion(twins, 1.0, 1.0).collect()] == [2]
    assert [r.id for r in spatial.deletion(twins, 1.0, 1.0, F.col("id") > 2).collect()] == [4]


def test_ids(spark):
    rows = spark.createDataFrame([(1000 + i, float(i), 0) for i in range(100)] + [(1042, -1.0, 1)], "id long, value double, seq int")
    newest = spatial.last_wins(rows, "seq")
    assert spatial.by_id(newest, 1042).first().value == -1.0
    assert spatial.by_id(newest, 9999).count() == 0 and newest.count() == 100
    assert spatial.lookup(spark.createDataFrame([(1000,), (7,)], "id long"), rows).count() == 1
    with pytest.raises(ValueError, match="1042"):
        PointSet(rows).check_unique()


def test_point_store(spark):
    store = spatial.PointStore(spark.createDataFrame([(0, 1.0, 2.0), (7, 3.0, 4.0)], "id long, x double, y double"))
    rows = spark.createDataFrame([(7, 5.0, 6.0, 1), (7, 8.0, 9.0, 2), (9, 0.0, 0.0, 1)], "id long, x double, y double, seq int")
    after = store.upsert(rows, "seq")
    assert after.count() == 3 and store.count() == 2
    assert [tuple(r) for r in after.get(7).collect()] == [(7, 8.0, 9.0)]
    assert after.exists(0) and after.exists(9) and not store.exists(9) and not after.exists(8)
    assert after.clear().count() == 0 and after.clear().upsert(rows, "seq").count() == 2


def test_groups_and_refresh(spark):
    rows = [(i, 0.01 * i, 0.0, i % 3, float(i % 3), 0.0) for i in range(60)]
    ps = points(spark, rows, 2)
    groups = similarity.groups_in_range(ps.df, Box(-1, -1, 1, 1), members=True).orderBy("label").collect()
    assert [(r.label, r.n) for r in groups] == [(0, 20), (1, 20), (2, 20)]
    assert sum(r.n for r in similarity.groups_in_range(ps.df, Box(-0.01, -0.01, 0.095, 0.01)).collect()) == 10
    grid = layout.Grid(0, 0, 0.1, 0.1)
    placed = ps.with_df(grid.assign(ps.df))
    summary = similarity.leaf_groups(placed)
    more = spatial.insert(ps, points(spark, [(60, 0.65, 0.0, 0, 9.0, 0.0)], 2).df)
    placed2 = more.with_df(grid.assign(more.df))
    changed = grid.assign(points(spark, [(60, 0.65, 0.0, 0, 9.0, 0.0)], 2).df)
    got = {(r.cell, r.label): (r.n, r.f0) for r in similarity.refreshed(summary, placed2, changed).collect()}
    want = {(r.cell, r.label): (r.n, r.f0) for r in similarity.leaf_groups(placed2).collect()}
    assert got == want
    touched = {r.cell: r.version for r in layout.versions(placed.df, changed, 5).collect()}
    assert touched["6:0"] == 5 and touched["0:0"] == 4


def similar_rows(spark):
    rows = [(e * 10 + i, 0.015 * (10 * e + i), 0.0, e, [0.0, 5.0, 9.0][e]) for e in range(3) for i in range(10)]
    return points(spark, [*rows, (999, 2.0, 2.0, 1, 5.0)], 1)


def test_n_similar(spark):
    ps, box = similar_rows(spark), Box(-0.01, -0.01, 0.51, 0.01)
    ref = similarity.reference(ps, 999)
    ten = similarity.n_similar(ps, box, ref, 10).collect()
    assert {r.label for r in ten} == {1} and len(ten) == 10
    fifteen = similarity.n_similar(ps, box, ref, 15).orderBy("rank").collect()
    assert [r.label for r in fifteen] == [1] * 10 + [2] * 5
    assert 999 not in {r.id for r in fifteen}
    assert similarity.n_similar(ps, box, ref, 0).count() == 0
    assert similarity.n_similar(ps, box, ref, 99).count() == 30
    assert similarity.n_similar(ps, box, similarity.reference(ps, 12345), 5).count() == 0


def test_older_variants(spark):
    rows = [(1, 0.0, 0.0, 1, 1, 0.0), (2, 1.0, 0.0, 1, 1, 0.0), (3, 2.0, 0.0, 1, 2, 1.0), (4, 0.5, 0.0, 2, 1, 0.0), (5, 9.0, 0.0, 1, 1, 0.0)]
    ps = points(spark, rows, 1, ("geo", "attr"))
    box, ref = Box(-1, -1, 3, 1), similarity.reference(ps, 1)
    scores = {r.id: r.score for r in similarity.legacy_score(ps, box, ref, 9).collect()}
    assert scores == pytest.approx({2: 1.0, 3: 0.5 * math.exp(-1) + 0.3, 4: 0.7})
    assert similarity.legacy_score(ps, box, ref, 0).count() == 0
    order = [r.id for r in similarity.legacy_priority(ps, box, ref, 3).orderBy("rank").collect()]
    assert order == [4, 2, 3]
    assert [r.id for r in similarity.cluster_priority(ps, box, ref, 2).collect()] == [2, 3]
    assert {r.id for r in similarity.similar_in_box(ps, box, ref, 0.9).collect()} == {1, 2, 4}
    assert {r.id for r in similarity.subcluster_in_box(ps.df, box, 1).collect()} == {1, 2, 4}
    with pytest.raises(ValueError):
        similarity.pair_similarity(ps, box, most=2)


def test_microclusters(spark):
    rows = [(1, 0.0, 0.0, 1, 1, 0.0), (2, 0.1, 0.0, 1, 1, 4.0), (3, 0.2, 0.0, 1, 2, 1.0), (4, 5.0, 0.0, 1, 1, 0.0)]
    ps = points(spark, rows, 1, ("geo", "attr"))
    placed = ps.with_df(layout.Grid(0, 0, 1, 1).assign(ps.df))
    (only,) = similarity.microclusters(placed).collect()
    assert (only.cell, only.n, only.m_f0, only.radius) == ("0:0", 2, 2.0, 2.0)
    total, top = similarity.microcluster_stats(similarity.microclusters(placed))
    assert tuple(total.first()) == (1, 2, 1) and top.count() == 1
    groups = similarity.legacy_groups(placed.df, Box(0.15, -1, 0.16, 1)).collect()
    assert [(r.cell, r.attr, r.n) for r in groups] == [("0:0", 1, 2)]  # points outside the box count


def test_vectors(spark):
    a, b = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0), F.lit(100.0))
    assert one(spark, v.array_distance(a, b))[0] == 5.0
    assert list(one(spark, v.padded(F.array(F.lit(1.0), F.lit(None).cast("double")), 4))[0]) == [1.0, 0.0, 0.0, 0.0]
    nine = [F.lit(float(i)) for i in range(9)]
    zero = [F.lit(0.0)] * 8 + [F.lit(99.0)]
    assert one(spark, v.similarity(nine, zero))[0] == pytest.approx(math.exp(-math.sqrt(sum(i * i for i in range(8)))))


@pytest.mark.parametrize("kind", ["grid", "slabs"])
def test_layout_loses_nothing(spark, kind):
    df = spark.createDataFrame(lcg(500), "id long, x double, y double")
    lay = layout.Grid(0, 0, 0.13, 0.21) if kind == "grid" else layout.Slabs.fit(df, 8)
    placed = lay.assign(df)
    stats = layout.cell_stats(placed)
    assert placed.count() == 500 and placed.where("cell is null").count() == 0
    assert stats.agg(F.sum("n")).first()[0] == 500
    inside = placed.join(stats, "cell").where("x between x0 and x1 and y between y0 and y1").count()
    assert inside == 500
    if kind == "slabs":
        assert stats.agg(F.max("n")).first()[0] <= 24 and stats.count() > 40


def test_layout_round_trip_prunes(spark, tmp_path):
    grid = layout.Grid(0, 0, 0.1, 0.1)
    df = spark.createDataFrame(lcg(400), "id long, x double, y double")
    layout.save(grid.assign(df), str(tmp_path / "cells"))
    again = layout.load(spark, str(tmp_path / "cells"), grid, grid)
    box = Box(0.2, 0.3, 0.5, 0.45)
    want = {r.id for r in spatial.in_box(df, box).collect()}
    query = grid.in_box(again, box)
    assert {r.id for r in query.collect()} == want
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "gx" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        layout.load(spark, str(tmp_path / "cells"), grid, layout.Grid(0, 0, 1, 1))


def test_points_in_boxes_equal_brute_force(spark):
    pts = lcg(200)
    boxes = [(i, x, y, x + 0.17, y + 0.08) for i, x, y in lcg(60, 99)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    bx = spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.id, r.box) for r in spatial.points_in_boxes(df, bx, 0.1, 0.1).collect()}
    want = {(i, b) for i, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 is not None and x0 <= x <= x1 and y0 <= y <= y1}
    assert got == want


def test_box_filter_is_pushed_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    plan = spatial.in_box(df, Box(1.0, 1.0, 2.0, 2.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in plan and "o_orderdate" not in plan


def test_split_axis(spark):
    rows = [(i, float(i), (i % 2) * 0.1) for i in range(9)]
    flat = spark.createDataFrame(rows, "id long, x double, y double")
    tall = spark.createDataFrame([(i, y, x) for i, x, y in rows], "id long, x double, y double")
    one, two = layout.best_split(flat, 3).first(), layout.best_split(tall, 3).first()
    assert (one.axis, two.axis) == (0, 1) and one.shared == two.shared == 0.0
    assert layout.splits(flat.withColumn("cell", F.lit("c")), 3).count() == 2 * 4
    assert layout.best_split(flat, 5).isEmpty() and layout.best_split(flat.limit(0), 1).isEmpty()


def brute_split(cell, least):
    box = lambda ps: (min(p[1] for p in ps), min(p[2] for p in ps), max(p[1] for p in ps), max(p[2] for p in ps))
    cuts = {}
    for axis in (0, 1):
        order = sorted(cell, key=lambda p: (p[1 + axis], p[1], p[2], p[0]))
        for k in range(least, len(cell) - least + 1):
            a, b = box(order[:k]), box(order[k:])
            margin = sum(2 * (r[2] - r[0] + r[3] - r[1]) for r in (a, b))
            shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            cuts.setdefault(axis, []).append((shared, sum((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b)), k, margin))
    axis = min(cuts, key=lambda a: (sum(c[3] for c in cuts[a]), a))
    return axis, min(cuts[axis])[2]


def test_best_split_of_every_full_cell(spark):
    rows = [(i, float(i * 37 % 101), float(i * i % 53)) for i in range(300)]
    grid = layout.Grid(0.0, 0.0, 40.0, 30.0)
    cells = {}
    for p in rows:
        cells.setdefault(f"{int(p[1] // 40)}:{int(p[2] // 30)}", []).append(p)
    got = {r.cell: (r.axis, r.first) for r in layout.best_splits(grid.assign(spark.createDataFrame(rows, "id long, x double, y double")), 40, 10).collect()}
    assert got == {c: brute_split(ps, 10) for c, ps in cells.items() if len(ps) > 40} and 1 < len(got) < len(cells)


def test_refine_bounds_cells_and_merges_after_deletion(spark):
    # a third at one place, others spread, left of the origin too; nulls have no cell
    rows = [(i, 3.0, 3.0) if i % 3 == 0 else (i, float(i % 40) - 8.0, float(i * 7 % 33) - 8.0) for i in range(600)] + [(900, None, 1.0), (901, 1.0, None)]
    grid, depth, most = layout.Grid(0.0, 0.0, 16.0, 16.0), 3, 20

    def brute(ps):
        out = {}
        at = lambda p, k: (int(p[1] // (16 / 2**k)), int(p[2] // (16 / 2**k)))
        for p in ps:
            if p[1] is None or p[2] is None:
                out[p[0]] = None
                continue
            k = next((k for k in range(depth) if sum(q[1] is not None and q[2] is not None and at(q, k) == at(p, k) for q in ps) <= most), depth)
            out[p[0]] = ":".join(map(str, (k, *at(p, k))))
        return out

    schema = "id long, x double, y double"
    got = {r.id: r.cell for r in layout.refine(spark.createDataFrame(rows, schema), grid, most, depth).collect()}
    assert got == brute(rows) and len({c[0] for c in got.values() if c}) > 1
    left = [p for p in rows if p[0] % 10 == 1]
    after = {r.id: r.cell for r in layout.refine(spark.createDataFrame(left, schema), grid, most, depth).collect()}
    assert after == brute(left) and any(after[i] != got[i] for i in after)
    assert layout.refine(spark.createDataFrame([], schema), grid, most, depth).isEmpty()


def embedded(spark, folder, n):
    """A folder with n embeddings of one label inside the box of the catalog's queries."""
    rows = [(i, 1, [0.05 * math.sin(i), 0.05 * math.cos(i), *[0.01 * ((i * (k + 3)) % 11) for k in range(18)]]) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_group_members_are_all_members(spark, tmp_path):
    (row,) = catalog.queries()["group_members"](spark, embedded(spark, tmp_path, 1500)).collect()
    assert row.n == 1500 and row.members == ",".join(map(str, range(1500)))


def test_microcluster_members_are_capped(spark):
    placed = spark.range(1500).selectExpr("id", "'0:0' cell", "1 geo", "1 attr")
    groups = similarity.microcluster_members(placed)
    assert [len(r.members) for r in groups.collect()] == [1500]
    assert [(r.n, r.members) for r in similarity.capped_members(groups).collect()] == [(1500, list(range(1000)))]


def test_whole_table_queries_equal_brute_force(spark):
    """Over all orders and customers, beside the queries of a part of them."""
    sf, q = "/root/testdata/sf0.001", catalog.queries()
    rows = catalog.orders(spark, sf).df.join(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey id", "o_orderstatus s"), "id").collect()
    boxes = {}
    for r in rows:
        x0, y0, x1, y1 = boxes.get(r.attr + r.s, (r.x, r.y, r.x, r.y))
        boxes[r.attr + r.s] = min(x0, r.x), min(y0, r.y), max(x1, r.x), max(y1, r.y)
    want = {}
    for a, b in ((a, b) for a in boxes for b in boxes if a < b):
        w, h = (min(boxes[a][k + 2], boxes[b][k + 2]) - max(boxes[a][k], boxes[b][k]) for k in (0, 1))
        want[a, b] = round(max(0, w) * max(0, h), 4), w >= 0 and h >= 0
    got = {(r.a, r.b): (r.shared, r.touching) for r in q["box_overlap_pairs"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-3), want[k][1]) for k in want)
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    places = [(k, k * 7919 % 500000, k * 104729 % 2400) for k in keys]
    want = {(r.id, k) for r in rows for k, x, y in places if x <= r.x <= x + 5000 and y <= r.y <= y + 50}
    got = [tuple(r) for r in q["points_in_boxes"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and any(k % 3 for _, k in want)
    got = q["centroids_onto_points"](spark, sf).collect()
    assert len(got) == len(rows) and any(r.geo >= 50 for r in got)
    for r in got:
        mine = [p for p in rows if p.geo == r.geo]
        assert (r.cx, r.cy) == pytest.approx((sum(p.x for p in mine) / len(mine), sum(p.y for p in mine) / len(mine)), abs=1e-5)


def test_pairs_by_blocks_equal_pairs_at_once(spark, monkeypatch):
    ps = points(spark, [(i, 0.01 * (i % 7), 0.0, 1, float((i * i) % 13), float(i % 5)) for i in range(90)], 2)
    once = sorted(similarity.pair_similarity(ps, Box(-1, -1, 1, 1)).collect())
    monkeypatch.setattr(similarity, "MOST_PAIRED", 50)
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 20, raising=False)
    assert sorted(similarity.pair_similarity(ps, Box(-1, -1, 1, 1)).collect()) == once and len(once) == 90 * 89 // 2


def test_more_cells_than_a_plan_holds(spark, monkeypatch):
    df = spark.createDataFrame(lcg(500), "id long, x double, y double")
    want = sorted(layout.Slabs.fit(df, 8).assign(df).collect())
    monkeypatch.setattr(layout, "MOST_CELLS", 20)
    assert sorted(layout.Slabs.fit(df, 8).assign(df).collect()) == want
