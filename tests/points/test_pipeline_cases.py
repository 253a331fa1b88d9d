"""Cleaning, profiles, series, models, sources and streams on small data."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import cleaning, layout, models, profile, series, sides, similarity
from geoquilt.plans import catalog
from geoquilt.schema import Box, PointSet, require_columns
from geoquilt.sources import binary, files
from geoquilt.streaming import updates

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_city_edges(spark):
    df = frame(spark, [(1, 40.5774, -74.0), (2, 40.6, -74.0), (3, 41.0, -74.0), (4, None, -74.0)], "id int, lat double, lon double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(cleaning.in_city(df, "lat", "lon")) == [1, 2]
    assert ids(cleaning.inside_city(df, "lat", "lon")) == [2]
    assert ids(cleaning.location_outliers(df, [("lat", "lon")])) == [1, 3]


def test_negatives(spark):
    df = frame(spark, [(1, -2.5, 1.0), (2, 3.0, 2.0), (3, None, 0.0)], "id int, a double, b double")
    assert [r.a for r in cleaning.clip_negatives(df, ["a"]).orderBy("id").collect()] == [0.0, 3.0, None]
    moved = cleaning.shift_negatives(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in moved] == [(0.0, 1.0), (5.5, 2.0), (None, 0.0)]
    total = cleaning.recomputed_total(df, ["a", "b"], "t").orderBy("id").collect()
    assert [r.t for r in total] == [-1.5, 5.0, 0.0]
    assert cleaning.drop_nulls(df).count() == 2


def test_rounding_and_arranging(spark):
    df = frame(spark, [(1, 0.125)], "id int, a double")
    assert df.select(cleaning.round_half_even("a", 2)).first()[0] == 0.12
    out = cleaning.arranged(df, {"value": "a", "key": "id"}, {"key": "string"})
    assert out.dtypes == [("value", "double"), ("key", "string")]
    assert cleaning.sample(spark.range(100), 7).count() == 7
    with pytest.raises(ValueError, match="zz"):
        require_columns(df, ["id", "zz"])


@pytest.mark.parametrize("n", [1, 2, 10, 100])
def test_positional_percentiles(spark, n):
    values = [float((i * 37) % 50) for i in range(n)]
    df = frame(spark, [(v,) for v in values] + [(None,)], "v double").repartition(3)
    asked = (0, 10, 50, 90, 99, 99.9, 100)
    got = {r.p: r.value for r in profile.positional_percentiles(df, "v", asked).collect()}
    ordered = sorted(values)
    assert got == {float(p): ordered[min(int(n * (p / 100)), n - 1)] for p in asked}


def test_profile_of_nulls_and_nothing(spark):
    df = frame(spark, [(None,), (0.0,), (-1.0,), (4.0,)], "a double")
    r = profile.column_profile(df, ["a"]).first()
    assert (r.n, r.min, r.max, r.median, r.negatives, r.zeros, r.nulls, r.null_percent) == (4, -1.0, 4.0, 0.0, 1, 1, 1, 25.0)
    assert profile.column_profile(df.limit(0), ["a"]).first().n == 0
    kept, out = profile.split_outliers(frame(spark, [(1, -1), (2, 3), (3, None)], "id int, c int"), "c")
    assert kept.count() == 2 and out.count() == 1


def python_forecasts(given, actual, bins):
    """The recurrences as plain loops."""
    ratio = [p / g if g else 0.0 for g, p in zip(given, actual, strict=True)]
    ma, r = [], ratio[0]
    ea, e = [], ratio[0]
    ev, v = [], actual[0]
    wv, w = [], actual[0]
    for i in range(len(given)):
        wv.append(w)
        w = int((2 * actual[i] + actual[i - 1]) / 3) if i else actual[0]
        if i % bins == 0:
            ma.append(0), ea.append(0), ev.append(0)
            continue
        ma.append(int(given[i] * r))
        r = sum(ratio[max(0, i - 2) : i + 1]) / min(3, i + 1)
        ea.append(int(given[i] * e))
        e = 0.6 * e + (1 - 0.6) * ratio[i]
        ev.append(v)
        v = int(0.3 * v + (1 - 0.3) * actual[i])
    return ma, ea, ev, wv


def test_forecasts_equal_loops(spark):
    rng = np.random.default_rng(3)
    bins, clusters = 9, 4
    given = rng.integers(0, 60, bins * clusters).tolist()
    actual = rng.integers(1, 60, bins * clusters).tolist()
    rows = [(i // bins * 10, i % bins, g, a) for i, (g, a) in enumerate(zip(given, actual, strict=True))]
    df = frame(spark, rows, "cluster long, bin long, given long, value long").repartition(3)
    df = df.withColumn("ratio", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("given").cast("double")), F.lit(0.0)))
    ma, ea, ev, wv = python_forecasts(given, actual, bins)
    order = lambda d: [r.predicted for r in d.orderBy("cluster", "bin").collect()]
    near = [abs(a - b) for a, b in zip(order(series.mean_of_ratios(df, bins)), ma, strict=True)]
    assert max(near) <= 1 and sum(near) <= 2  # sums in another order may cut differently
    assert order(series.exponential_ratios(df, bins)) == ea
    assert order(series.exponential_values(df, bins)) == ev
    assert order(series.weighted_values(df, bins)) == wv
    assert order(series.mean_of_values(df, bins)) == [actual[0], *actual[:-1]]
    each = [python_forecasts(given[k : k + bins], actual[k : k + bins], bins)[2] for k in range(0, len(given), bins)]
    assert order(series.exponential_values(df, bins, carry=False)) == [x for part in each for x in part]
    err = series.forecast_error(series.mean_of_values(df, bins)).first()
    loss = [abs(a - b) for a, b in zip([actual[0], *actual[:-1]], actual, strict=True)]
    assert err.mape == pytest.approx(np.mean(loss) / np.mean(actual)) and err.mse == pytest.approx(np.mean(np.square(loss)))


def test_series_frames(spark):
    df = frame(spark, [(1, 0, 5), (1, 2, 9), (2, 1, 4)], "cluster long, bin long, value long")
    full = series.zero_filled(df, 4)
    assert full.count() == 8 and full.agg(F.sum("value")).first()[0] == 18
    assert {(r.cluster, r["empty"]) for r in series.empty_bins(df, 4).collect()} == {(1, 2), (2, 3)}
    smooth = {(r.cluster, r.bin): r.value for r in series.smoothed(df, 4).collect()}
    assert smooth == {(1, 0): 5, (1, 1): 4, (1, 2): 9, (1, 3): 4, (2, 0): 2, (2, 1): 4, (2, 2): 1, (2, 3): 1}
    parts = series.time_split(full, 0.7).groupBy("cluster", "part").count().collect()
    assert {(r.part, r["count"]) for r in parts} == {("train", 2), ("test", 2)}
    waves = frame(spark, [(1, i, int(100 + 50 * math.sin(2 * math.pi * i / 8))) for i in range(64)], "cluster long, bin long, value long")
    assert series.spectrum_features(waves).first().f_0 == pytest.approx(1 / 8)
    assert [r.bin for r in series.peaks(frame(spark, [(1, 0, 1), (1, 1, 300), (1, 2, 2)], "cluster long, bin long, value long")).collect()] == [1]


def test_standardising(spark):
    df = frame(spark, [(1, 1.0, "a"), (2, 3.0, "a"), (3, 7.0, "b")], "id int, v double, g string")
    pop = {r.id: r.v for r in models.standardized(df, ["v"], by=["g"], population=True).collect()}
    assert pop == {1: -1.0, 2: 1.0, 3: 0.0}
    with pytest.raises(ValueError, match="v"):
        models.standardized(df.where("id = 1").union(df.where("id = 1")), ["v"])


def test_components(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=200)
    rows = [(i, float(t[i]), float(2 * t[i] + 0.01 * rng.normal()), float(0.1 * rng.normal())) for i in range(200)]
    df = frame(spark, rows, "id int, a double, b double, c double")
    out, shares = models.components(df, ["a", "b", "c"], share=0.9)
    assert len(shares) == 1 and shares[0] > 0.9 and "PC1" in out.columns and "PC2" not in out.columns
    assert np.corrcoef([r.PC1 for r in out.orderBy("id").collect()], t)[0, 1] > 0.99
    assert models.explained_variance([0.5, 0.25])[1] == (2, 0.25, 0.75)


def blobs(spark, per=40):
    rng = np.random.default_rng(1)
    rows = [(k * per + i, "z", float(k * 5 + rng.normal() * 0.2), float(rng.normal() * 0.2)) for k in range(3) for i in range(per)]
    return frame(spark, rows, "id long, zone string, x double, y double")


def test_clustering(spark):
    df = blobs(spark)
    out, centres, inertia = models.clusters(df, ["x", "y"], 3)
    assert [round(c[0] / 5) for c in centres] == [0, 1, 2] and inertia < 30
    assert all(r.cluster == r.id // 40 for r in out.collect())
    assert models.best_k(df, ["x", "y"], range(2, 6))[0] == 3
    assert {r.subcluster == r.id // 40 for r in models.subclusters(df, "zone", ["x", "y"], 3, scale=False).collect()} == {True}
    assert models.subclusters(df.limit(1), "zone", ["x", "y"], 3).first().subcluster == 0
    assert models.best_k_by_group(df, "zone", ["x", "y"], per=20).first().k == 3
    assert models.best_k_by_group(df.limit(2), "zone", ["x", "y"]).first().k == 1
    fixed = models.clusters_with_fixed(df.select("id", "x", "y"), [(0.0, 0.0)], 2, 2.0).collect()
    assert all(r.cluster == r.id // 40 for r in fixed)
    (row,) = models.spacing_sweep(df, [3])
    assert row[0] == 3 and row[2] > 100


@pytest.mark.parametrize("kind", ["linear", "forest", "boosted"])
def test_regressions(spark, kind):
    rows = [(i, float(i), 3 * i + 2) for i in range(60)]
    df = frame(spark, rows, "id int, a double, value long")
    out = models.forecasts(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), ["a"], kind=kind)
    assert out.agg(F.avg("error")).first()[0] < (0.01 if kind == "linear" else 25)


def test_csv(spark, tmp_path):
    text = "geo,attr,id,x,y,f0,f1,f2\n1,2,3,4.0,5.0,6.0,7.0,8.0\n\n1,2,bad,4.0,5.0,6.0,7.0,8.0\n1,2,4,4.5,5.0,6.0,7.0,8.0\n"
    path = tmp_path / "points.csv"
    path.write_text(text)
    ps = files.read_points_csv(spark, str(path), 3, most_features=2)
    assert sorted(r.id for r in ps.df.collect()) == [3, 4] and ps.features == ("f0", "f1")
    assert files.read_points_csv(spark, str(path), 3, limit=1).df.count() == 1
    assert files.first_existing(spark, [str(tmp_path / "no"), str(path)]) == str(path)
    files.write_csv(ps.df, str(tmp_path / "out"), 3)
    assert files.count_rows(spark, str(tmp_path / "out")) == 2
    assert [r.id for r in files.head_copy(ps.df, 1, ["id"]).collect()] == [3]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])


@pytest.mark.parametrize("layout_name", [binary.CLASSIC, binary.PLAIN, binary.COMPACT, binary.LOOSE])
def test_binary_round_trip(spark, tmp_path, layout_name):
    binary.register(spark)
    width = (lambda i: 3) if layout_name == binary.COMPACT else (lambda i: i % 4)
    labels = lambda i: (i % 5, -1)[: len(binary.LABELS[layout_name])]
    rows = [(i, i * 0.5, -i * 0.25, *labels(i), [float(i + k) for k in range(width(i))]) for i in range(300)]
    df = spark.createDataFrame(rows, binary.schema_of(layout_name)).repartition(3)
    path = str(tmp_path / layout_name)
    df.write.format("pointfile").option("layout", layout_name).mode("append").save(path)
    again = spark.read.format("pointfile").option("layout", layout_name).load(path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    few = spark.read.format("pointfile").option("layout", layout_name).option("limit", 5).load(path)
    assert few.count() >= 5 and (layout_name == binary.LOOSE or few.count() == 5)
    if layout_name in (binary.CLASSIC, binary.PLAIN):
        size = sum(f.stat().st_size for f in (tmp_path / layout_name).glob("part-*"))
        assert size == 3 * 4 + (128 if layout_name == binary.CLASSIC else 120) * 300


def test_binary_rejects_other_files(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "bad.bin").write_bytes(b"\x05\0\0\0abc")
    with pytest.raises(Exception, match="points take"):
        spark.read.format("pointfile").load(str(tmp_path / "bad.bin")).count()


def test_sorted_export(spark, tmp_path):
    df = spark.createDataFrame([(i, float((i * 7) % 50), 0.0, 1, [1.0, 2.0]) for i in range(100)], binary.schema_of(binary.COMPACT))
    binary.sorted_export(df, str(tmp_path / "sorted"))
    xs = []
    for f in sorted((tmp_path / "sorted").glob("part-*")):
        data = np.frombuffer(f.read_bytes()[4:], binary.record(binary.COMPACT, 2))
        xs += data["x"].tolist()
        assert f.stat().st_size == 4 + len(data) * (28 + 8 * 2)
    assert xs == sorted(xs) and len(xs) == 100


def test_summary_follows_a_stream(spark, tmp_path):
    grid = layout.Grid(0, 0, 1, 1)
    rows = spark.createDataFrame([(i, float(i % 4), 0.0, i % 2, float(i)) for i in range(40)], "id long, x double, y double, label int, f0 double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    held = updates.GroupSummary(spark, str(tmp_path / "held"), grid, ("f0",))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held.follow(stream, str(tmp_path / "ck")).awaitTermination()
    want = similarity.leaf_groups(PointSet(grid.assign(rows), ("f0",), ("label",)))
    key = lambda d: sorted((r.cell, r.label, r.n, round(r.f0, 9)) for r in d.collect())
    assert key(held.summary()) == key(want)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = updates.windowed_counts(stream, "ts", "user_id").writeStream.outputMode("complete").format("memory").queryName("wc")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from wc").first()[0] == events.count()


def test_boosting_runs_a_thousand_rounds(spark, monkeypatch):
    asked = {}

    def regressor(**given):
        asked.update(given)
        return real(**given | {"maxIter": 2})

    real = models.GBTRegressor
    monkeypatch.setattr(models, "GBTRegressor", regressor)
    monkeypatch.setattr(models, "BOOSTED", 0)  # Spark's, which takes over beyond so many rows
    df = frame(spark, [(float(i), i) for i in range(20)], "a double, value int")
    assert models.forecasts(df, df, ["a"], kind="boosted").count() == 20
    assert (asked["maxIter"], asked["maxDepth"], asked["stepSize"], asked["subsamplingRate"]) == (1000, 3, 0.1, 0.8)


def test_best_k_of_a_group_sees_all_rows(spark):
    """Every other row of the order by x would show two clusters of four."""
    rows = [("z", 1e-6 * i, (0.0, 100.0, 10.0, 110.0)[i % 4]) for i in range(4000)]
    df = frame(spark, rows, "zone string, x double, y double")
    assert models.best_k_by_group(df, "zone", ["x", "y"]).first().k == 4


def test_clusters_take_the_best_of_three_starts(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, [tuple(map(float, p)) for p in rng.random((60, 2))], "x double, y double").coalesce(1)
    costs = [models.clusters(df, ["x", "y"], 9, seed=models.SEED + i, starts=1)[2] for i in range(3)]
    assert min(costs) < costs[0] and models.clusters(df, ["x", "y"], 9)[2] == pytest.approx(min(costs))


def test_best_k_query_tries_every_k(spark):
    assert sorted(r.k for r in catalog.queries()["best_k"](spark, SF).collect()) == list(range(2, 21))


def test_catalog_models_keep_invariants(spark):
    q = catalog.queries()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    labels = q["kmeans_labels"](spark, SF).collect()
    assert len(labels) == n and {r.cluster for r in labels} == set(range(8))
    assert q["attribute_subclusters"](spark, SF).agg(F.max("subcluster")).first()[0] <= 4
    assert q["best_k"](spark, SF).where("chosen").count() == 1
    assert q["linear_forecast"](spark, SF).count() > 0
    assert Box(0, 0, 1, 1).empty is False


def test_boosted_in_memory():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = np.where(x[:, 0] > 0.5, 5.0, 0.0) + x[:, 1] * 2
    model = models.Boosted(x, y)
    assert len(model.trees) == 1000 and np.abs(model.predict(x) - y).mean() < 0.05
    assert np.allclose(models.Boosted(x, y).predict(x), model.predict(x))
    assert models.Boosted(np.zeros((0, 2)), np.zeros(0)).predict(np.ones((1, 2))).tolist() == [0.0]
    same = models.Boosted(np.ones((5, 1)), np.full(5, 3.0), rounds=3)
    assert np.allclose(same.predict(np.zeros((2, 1))), 3.0)


def test_carried_sequence_of_a_month_is_read_once(spark):
    """40 clusters of 4,464 ten-minute bins: one sequence of 178,560."""
    rows = spark.range(178_560).selectExpr("id div 4464 AS cluster", "id % 4464 AS bin", "id % 97 AS value")
    began = time.perf_counter()
    out = series.exponential_values(rows, 4464).orderBy("i").select("predicted", "value").toPandas()
    assert time.perf_counter() - began < 20
    state = 0
    for nth, (predicted, value) in enumerate(zip(out["predicted"].tolist(), out["value"].tolist(), strict=True)):
        assert predicted == (0 if nth % 4464 == 0 else state)
        state = state if nth % 4464 == 0 else int(state * 0.3 + value * 0.7)


def test_nearest_of_many_centres(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points, centres = rng.random((200, 2)), rng.random((60, 2))
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    cs = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(centres)], "centre int, cx double, cy double")
    key = lambda rows: sorted((r.id, r.centre, r.distance and round(r.distance, 9)) for r in rows)
    want = key(models.nearest_centre(df, cs, 0.07).collect())
    monkeypatch.setattr(models, "MOST_CENTRES", 10)
    assert key(models.nearest_centre(df, cs, 0.07).collect()) == want and any(c is None for _, c, _ in want)


def test_small_sides(spark):
    rows = spark.range(50)
    assert "Broadcast" in sides.few(rows, 50).join(spark.range(9), "id")._jdf.queryExecution().toString()
    assert sides.few(rows, 49) is rows and sides.few(rows.limit(0), 5).count() == 0
