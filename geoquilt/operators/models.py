"""Standardising, components, clusters and regressions, on Spark's own estimators.

Labels are renumbered by the order of their centres and components have their largest loading
positive, so that results don't depend on how an estimator numbers or signs them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.functions import geometry as g
from geoquilt.sources import files

# Fixed value, on which labels depend.
SEED = 42
#: Points on which a silhouette is computed; the number of its distances is the square of that.
SILHOUETTE_SAMPLE = 10_000
#: Starts of a k-means, of which the one with the least inertia holds.
STARTS = 3
#: Centres up to which all go to every row.
MOST_CENTRES = 1000
#: Rounds of boosting, depth of a tree, its weight, the share of rows it sees, value ranges of a
#: feature; rows up to which a model is boosted in memory.
ROUNDS, DEPTH, RATE, SEEN, VALUE_RANGES, BOOSTED = 1000, 3, 0.1, 0.8, 64, 200_000
SILHOUETTE_BLOCK = 512


def standardized(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), population: bool = False) -> DataFrame:
    """Columns less their mean over their deviation: the sample's, where a constant column is an
    error, or the population's, where it becomes 0. With `by`, within groups."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}__m"), std(c).alias(f"{c}__s"))]
    if by:
        stats = df.groupBy(*by).agg(*aggs)
        joined = df.join(stats, list(by))
    else:
        stats = df.agg(*aggs)
        joined = df.join(F.broadcast(stats))
        if not population:
            row = stats.first()
            flat = [c for c in columns if not row[f"{c}__s"]]
            if flat:
                raise ValueError(f"no spread in: {', '.join(flat)}")
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s")), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{c}__{k}" for c in columns for k in "ms"])


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="__v").transform(df)


def components(df: DataFrame, columns: Sequence[str], k: int | None = None, share: float | None = None, digits: int = 10):
    """(df with PC1..PCk rounded, explained shares). k components or, given a share, the fewest
    that explain more than it together."""
    rows = assembled(df, columns)
    model = PCA(k=k or len(columns), inputCol="__v", outputCol="__pc").fit(rows)
    explained = model.explainedVariance.toArray()
    if share is not None:
        k = min(int(np.searchsorted(np.cumsum(explained), share, side="right")) + 1, len(columns))
    k = k or len(columns)
    loadings = model.pc.toArray()[:, :k]
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    out = model.transform(rows).withColumn("__a", vector_to_array("__pc"))
    named = {f"PC{i + 1}": F.round(F.col("__a")[i] * F.lit(float(signs[i])), digits) for i in range(k)}
    return out.withColumns(named).drop("__v", "__pc", "__a"), explained[:k]


def explained_variance(shares: Sequence[float]) -> list[tuple[int, float, float]]:
    """(component, share, share up to it)."""
    total = np.cumsum(shares)
    return [(i + 1, float(s), float(t)) for i, (s, t) in enumerate(zip(shares, total, strict=True))]


def clusters(
    df: DataFrame, columns: Sequence[str], k: int, label: str = "cluster", seed: int = SEED, iterations: int = 100, tolerance: float = 1e-3, starts: int = STARTS
):
    """(df with labels, centres, inertia) of the best of several starts, of equals the first.
    Labels go by the order of the centres."""
    rows = assembled(df, columns)
    means = [KMeans(k=k, seed=seed + i, maxIter=iterations, tol=tolerance, featuresCol="__v", predictionCol="__k") for i in range(starts)]
    points = rows.select("__v").cache()
    model = min((m.fit(points) for m in means), key=lambda m: m.summary.trainingCost)
    points.unpersist()
    centres = [c.tolist() for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    rank = {old: new for new, old in enumerate(order)}
    number = F.get(F.array(*[F.lit(rank[i]) for i in range(len(centres))]), F.col("__k"))
    out = model.transform(rows).withColumn(label, number).drop("__v", "__k")
    return out, [centres[i] for i in order], float(model.summary.trainingCost)


def nearest_centre(df: DataFrame, centres: DataFrame, radius: float = 0.015, x: str = "x", y: str = "y") -> DataFrame:
    """With `centre` and `distance`: the nearest of given centres (centre, cx, cy), null beyond a
    radius; of equals the least. Up to MOST_CENTRES go to every row as one array, so that nothing
    is shuffled. Of more, a row meets those of its cell of a grid as wide as the radius and of the
    eight around it, which hold all that are near enough."""
    away = lambda c: g.planar_distance(F.col(x), F.col(y), c["cx"], c["cy"])
    ranked = F.transform("__cs", lambda c: F.struct(away(c).alias("d"), c["centre"].alias("centre")))
    listed = F.collect_list(F.struct("centre", "cx", "cy")).alias("__cs")
    if centres.limit(MOST_CENTRES + 1).count() <= MOST_CENTRES:
        near = df.join(F.broadcast(centres.agg(listed)))
    else:
        cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        spread = centres.withColumn("__gx", around("cx")).withColumn("__gy", around("cy"))
        lists = spread.groupBy("__gx", "__gy").agg(listed)
        near = df.withColumns({"__gx": cell(x), "__gy": cell(y)}).join(lists, ["__gx", "__gy"], "left").drop("__gx", "__gy")
    near = near.withColumn("__b", F.array_min(ranked))
    inside = F.col("__b.d") < radius
    out = near.withColumns({"centre": F.when(inside, F.col("__b.centre")), "distance": F.when(inside, F.col("__b.d"))})
    return out.drop("__cs", "__b")


def clusters_with_fixed(df: DataFrame, centres: list[tuple[float, float]], k: int, radius: float = 0.015, seed: int = SEED) -> DataFrame:
    """Labels 0.. of given centres for points near them, then k-means of the rest."""
    few = df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(centres)], "centre int, cx double, cy double")
    placed = nearest_centre(df, few, radius)
    rest = placed.where("centre is null").drop("centre", "distance")
    own = placed.where("centre is not null").withColumnRenamed("centre", "cluster").drop("distance")
    found, _, _ = clusters(rest, ["x", "y"], k, seed=seed)
    return own.unionByName(found.withColumn("cluster", F.col("cluster") + len(centres)))


def centre_spacing(centres: DataFrame, miles: float = 2.0) -> DataFrame:
    """(centre, within, beyond, nearest): other centres (centre, lat, lon) up to a distance and
    beyond, and the least distance in miles."""
    a = centres.toDF("centre", "lat", "lon")
    b = centres.toDF("other", "lat2", "lon2")
    d = g.haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = a.join(F.broadcast(b), F.col("centre") != F.col("other")).withColumn("d", d)
    return pairs.groupBy("centre").agg(F.count_if(F.col("d") <= miles).alias("within"), F.count_if(F.col("d") > miles).alias("beyond"), F.min("d").alias("nearest"))


def spacing_sweep(df: DataFrame, ks: Sequence[int], x: str = "x", y: str = "y", seed: int = SEED) -> list[tuple[int, float, float]]:
    """(k, mean centres within two miles, least distance) of k-means for each k."""
    df = df.select(x, y).cache()
    out = []
    for k in ks:
        _, centres, _ = clusters(df, [x, y], k, seed=seed)
        table = df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(centres)], "centre int, lat double, lon double")
        row = centre_spacing(table).agg(F.avg("within"), F.min("nearest")).first()
        out.append((k, float(row[0]), float(row[1])))
    df.unpersist()
    return out


def _away(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.stack([((z - c) ** 2).sum(1) for c in centres], 1)


def _lloyd(z: np.ndarray, k: int, seed: int, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(inertia, labels, centres) of Lloyd's algorithm, from spread starting points."""
    rng = np.random.default_rng(seed)
    centres = z[[rng.integers(len(z))]]
    least = _away(z, centres)[:, 0]
    while len(centres) < k:
        centres = np.vstack([centres, z[least.argmax()]])
        least = np.minimum(least, _away(z, centres[-1:])[:, 0])
    label = np.zeros(len(z), int)
    for _ in range(rounds):
        new = _away(z, centres).argmin(1)
        centres = np.array([z[new == i].mean(0) if (new == i).any() else centres[i] for i in range(k)])
        if (new == label).all():
            break
        label = new
    return float(((z - centres[label]) ** 2).sum()), label, centres


def _kmeans(z: np.ndarray, k: int, seed: int, rounds: int = 50, starts: int = STARTS) -> np.ndarray:
    """Labels of one group's rows by the best of several starts, of equals the first."""
    _, label, centres = min((_lloyd(z, k, seed + i, rounds) for i in range(starts)), key=lambda x: x[0])
    rank = {old: i for i, old in enumerate(sorted(range(k), key=lambda i: centres[i].tolist()))}
    return np.array([rank[i] for i in label])


def subclusters(df: DataFrame, by: str, columns: Sequence[str], k: int, label: str = "subcluster", scale: bool = True, seed: int = SEED) -> DataFrame:
    """min(k, n) clusters in each group; a group of one row has label 0. A group is fitted in
    one task: groups are zones of a bounded number of rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf[list(columns)].to_numpy(float)
        if scale:
            spread = z.std(0)
            z = (z - z.mean(0)) / np.where(spread > 0, spread, 1)
        n = min(k, len(np.unique(z, axis=0)))
        order = np.lexsort(z.T[::-1])
        found = np.zeros(len(z), int)
        if n > 1:
            found[order] = _kmeans(z[order], n, seed)
        return pdf.assign(**{label: found})

    return df.groupBy(by).applyInPandas(one, df.withColumn(label, F.lit(0).cast("int")).schema)


def silhouette(df: DataFrame, columns: Sequence[str], label: str, sample: int = SILHOUETTE_SAMPLE) -> float:
    """Mean silhouette by Euclidean distance, exact on a sample of `sample` rows by hash."""
    rows = df.select(*columns, label).orderBy(F.xxhash64(*columns), *columns).limit(sample).toPandas()
    return _silhouette(rows[list(columns)].to_numpy(float), rows[label].to_numpy())


def _silhouette(z: np.ndarray, y: np.ndarray) -> float:
    names, y = np.unique(y, return_inverse=True)
    if len(names) < 2 or len(names) >= len(z):
        return 0.0
    size = np.bincount(y)
    one_hot = np.eye(len(names))[y]
    total = 0.0
    for i in range(0, len(z), SILHOUETTE_BLOCK):
        part = z[i : i + SILHOUETTE_BLOCK]
        d = np.zeros((len(part), len(z)))
        for f in range(z.shape[1]):
            d += (part[:, f, None] - z[None, :, f]) ** 2
        sums = np.sqrt(d) @ one_hot
        own = y[i : i + SILHOUETTE_BLOCK]
        at = np.arange(len(part))
        a = sums[at, own] / np.maximum(size[own] - 1, 1)
        means = sums / size
        means[at, own] = np.inf
        b = means.min(1)
        total += np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
    return float(total / len(z))


def best_k(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 21), seed: int = SEED, sample: int = SILHOUETTE_SAMPLE):
    """(k, scores by k): the first of the highest silhouette."""
    df = df.cache()
    scores = {k: silhouette(clusters(df, columns, k, seed=seed)[0], columns, "cluster", sample) for k in ks}
    df.unpersist()
    return max(scores, key=lambda k: (scores[k], -k)), scores


def best_k_by_group(
    df: DataFrame, by: str, columns: Sequence[str], most: int = 20, per: int = 1000, seed: int = SEED, sample: int = SILHOUETTE_SAMPLE
) -> DataFrame:
    """(by, k): k of 2..max(2, min(most, n / per)) by silhouette in each group, 1 below 3 rows. All
    rows of a group are fitted, in one task; silhouettes are of `sample` of them at most."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf[list(columns)].to_numpy(float)
        z = z[np.lexsort(z.T[::-1])]
        best, top = 1, -2.0
        if len(z) >= 3:
            seen = np.arange(len(z))
            if len(z) > sample:
                seen = np.sort(np.random.default_rng(seed).choice(len(z), sample, replace=False))
            for k in range(2, max(2, min(most, len(z) // per)) + 1):
                y = _kmeans(z, min(k, len(z)), seed)
                if len(np.unique(y)) > 1 and (s := _silhouette(z[seen], y[seen])) > top:
                    best, top = k, s
        return pd.DataFrame([[pdf[by].iloc[0], best]], columns=[by, "k"])

    return df.groupBy(by).applyInPandas(one, f"{by} {dict(df.dtypes)[by]}, k int")


class Boosted:
    """Regression trees, each fitted to what the ones before leave, on features in ranges."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED):
        shares = np.arange(1, VALUE_RANGES) / VALUE_RANGES
        self.cuts = [np.unique(np.quantile(c, shares, method="lower")) if len(c) else np.empty(0) for c in x.T]
        codes = self._codes(x)
        self.base = float(y.mean()) if len(y) else 0.0
        #: by round: feature and range of each inner node, top first, then values of the leaves
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rng, left = np.random.default_rng(seed), y - self.base
        for _ in range(rounds if len(y) else 0):
            seen = rng.random(len(y)) < SEEN
            if not seen.any():
                continue
            tree = self._grown(codes[seen], left[seen])
            self.trees.append(tree)
            left = left - self._leaf(tree, codes)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)

    @staticmethod
    def _grown(codes: np.ndarray, rest: np.ndarray):
        n, m = codes.shape
        feature, limit = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, VALUE_RANGES)
        node, wide = np.zeros(n, int), VALUE_RANGES
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-12)
            for f in range(m):
                at = node * wide + codes[:, f]
                count = np.bincount(at, minlength=nodes * wide).reshape(nodes, wide).cumsum(1)
                total = np.bincount(at, rest, nodes * wide).reshape(nodes, wide).cumsum(1)
                n1, s1 = count[:, :-1], total[:, :-1]
                n2, s2 = count[:, -1:] - n1, total[:, -1:] - s1
                gain = np.where((n1 > 0) & (n2 > 0), s1**2 / np.maximum(n1, 1) + s2**2 / np.maximum(n2, 1), 0.0)
                gain -= np.where(gain > 0, total[:, -1:] ** 2 / np.maximum(count[:, -1:], 1), 0.0)
                cut = gain.argmax(1)
                gain = gain[np.arange(nodes), cut]
                better = np.flatnonzero(gain > best)
                best[better], feature[first + better], limit[first + better] = gain[better], f, cut[better]
            split = first + node
            node = 2 * node + (codes[np.arange(n), feature[split]] > limit[split])
        leaves = 2**DEPTH
        return feature, limit, RATE * np.bincount(node, rest, leaves) / np.maximum(np.bincount(node, minlength=leaves), 1)

    @staticmethod
    def _leaf(tree, codes: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        node, rows = np.zeros(len(codes), int), np.arange(len(codes))
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (codes[rows, feature[at]] > limit[at])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, out = self._codes(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += self._leaf(tree, codes)
        return out


def _boosted(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in (*columns, target)]).toPandas()
    model = Boosted(rows[list(columns)].to_numpy(float), rows[target].to_numpy(float))

    @F.pandas_udf("double")
    def predicted(*features: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([f.to_numpy(float) for f in features], 1)))

    return test.withColumn("prediction", predicted(*[F.col(c).cast("double") for c in columns]))


def forecasts(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str = "value", kind: str = "linear") -> DataFrame:
    """test with `predicted`, rounded: by linear regression, a forest of 40 trees or 1,000 rounds of
    boosting. A boosted model of up to BOOSTED rows, which clusters times bins seldom exceed, is
    fitted in memory; of more, by Spark, whose jobs for each round are cut by checkpoints."""
    makers = {
        "linear": lambda: LinearRegression(featuresCol="__v", labelCol=target),
        "forest": lambda: RandomForestRegressor(featuresCol="__v", labelCol=target, numTrees=40, featureSubsetStrategy="sqrt", minInstancesPerNode=4, seed=SEED),
        "boosted": lambda: GBTRegressor(featuresCol="__v", labelCol=target, maxDepth=DEPTH, maxIter=ROUNDS, stepSize=RATE, subsamplingRate=SEEN, seed=SEED),
    }
    if kind not in makers:
        raise ValueError(f"no such model: {kind}")
    if kind == "boosted" and train.limit(BOOSTED + 1).count() <= BOOSTED:
        out = _boosted(train, test, columns, target)
    else:
        context = train.sparkSession.sparkContext
        if kind == "boosted" and not context.getCheckpointDir():
            context.setCheckpointDir(files.scratch(train.sparkSession, "boosting"))
        as_double = lambda d: d.withColumn(target, F.col(target).cast("double"))
        out = makers[kind]().fit(assembled(as_double(train), columns)).transform(assembled(as_double(test), columns)).drop("__v")
    out = out.withColumn("predicted", F.round("prediction").cast("long"))
    return out.withColumn("error", F.abs(F.col("predicted") - F.col(target)).cast("double")).drop("prediction")


def group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the means of their group as m_<column>."""
    w = W.partitionBy(by)
    return df.withColumns({f"m_{c}": F.avg(c).over(w) for c in columns})
