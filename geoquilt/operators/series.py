"""Time bins, zero filling, lags and forecasts of counts per cluster.

A series is rows (cluster, bin, value) with every bin from 0 to bins - 1 of every cluster. The
forecasts run over each cluster by itself or, with carry, over all clusters as one sequence in
cluster order, where `i` counts through. A carried sequence is one task, as each value depends
on the one before; it has clusters times bins rows, whatever the number of trips.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values, on which results depend.
#: Ten minutes; the shift that the month's first bin has by default.
BIN_SECONDS, SHIFT = 600, 33


def unix_seconds(c: str) -> Column:
    """Of a timestamp, in the session's zone (pinned to UTC)."""
    return F.unix_timestamp(c)


def time_bin(seconds: Column, start: int, width: int = BIN_SECONDS, shift: int = SHIFT) -> Column:
    """int((t - start) / width) + shift."""
    return ((seconds - F.lit(start)) / F.lit(float(width))).cast("long") + F.lit(shift)


def weekday(bin: str = "bin", per_day: int = 144, first: int = 4) -> Column:
    """Day of the week of a bin, whose bin 0 falls on day `first`."""
    return (F.floor(F.col(bin) / per_day) % 7 + first) % 7


def counts(df: DataFrame, cluster: str, bin: str, value: str) -> DataFrame:
    """(cluster, bin, value): rows of each cluster and bin in which `value` is not null."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(bin).alias("bin")).agg(F.count(value).alias("value"))


def empty_bins(series: DataFrame, bins: int) -> DataFrame:
    """(cluster, empty): how many of the bins a cluster has no rows in."""
    return series.groupBy("cluster").agg((F.lit(bins) - F.count_distinct("bin")).alias("empty"))


def bins_of(series: DataFrame) -> DataFrame:
    """(cluster, bins): the distinct bins of each cluster, ascending."""
    return series.groupBy("cluster").agg(F.array_sort(F.collect_set("bin")).alias("bins"))


def zero_filled(series: DataFrame, bins: int) -> DataFrame:
    """Every cluster with every bin, 0 where there was none."""
    full = series.select("cluster").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return full.join(series, ["cluster", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def smoothed(series: DataFrame, bins: int) -> DataFrame:
    """Empty bins share what their neighbours have: a gap and the filled bin on each side get
    the mean of that stretch, cut to whole numbers. At the ends there is one neighbour. (Our
    definition.)"""
    full = zero_filled(series, bins).join(series.select("cluster", "bin", F.lit(True).alias("there")), ["cluster", "bin"], "left")
    w = W.partitionBy("cluster").orderBy("bin")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("there"), F.col("bin"))
    sides = full.withColumns({
        "low": F.last(at, True).over(back), "high": F.first(at, True).over(ahead),
        "left": F.last(F.when(F.col("there"), F.col("value")), True).over(back),
        "right": F.first(F.when(F.col("there"), F.col("value")), True).over(ahead),
    })
    long = F.coalesce("high", F.lit(bins - 1)) - F.coalesce("low", F.lit(0)) + 1
    mean = ((F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))) / long).cast("long")
    return sides.select("cluster", "bin", F.when(F.col("there"), F.col("value")).otherwise(mean).alias("value"))


def ratios(given: DataFrame, actual: DataFrame) -> DataFrame:
    """(cluster, bin, given, value, ratio): a later series over an earlier one, 0 over 0 bins."""
    joined = given.withColumnRenamed("value", "given").join(actual, ["cluster", "bin"])
    return joined.withColumn("ratio", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("given").cast("double")), F.lit(0.0)))


def numbered(series: DataFrame, bins: int) -> DataFrame:
    """With `i`, the place in the sequence of all clusters in order, by arithmetic: clusters are
    few, and their order is the only thing that is ranked."""
    order = series.select("cluster").distinct().withColumn("nth", F.row_number().over(W.orderBy("cluster")) - 1)
    return series.join(F.broadcast(order), "cluster").withColumn("i", F.col("nth") * bins + F.col("bin")).drop("nth")


def _window(carry: bool):
    return W.orderBy("i") if carry else W.partitionBy("cluster").orderBy("bin")


def lags(series: DataFrame, n: int = 5) -> DataFrame:
    """ft_n .. ft_1: the values of the n bins before, nearest last; null before the start."""
    w = W.partitionBy("cluster").orderBy("bin")
    return series.withColumns({f"ft_{k}": F.lag("value", k).over(w) for k in range(n, 0, -1)})


def mean_of_ratios(rows: DataFrame, bins: int, width: int = 3, carry: bool = True) -> DataFrame:
    """Moving mean of ratios: prediction int(given * r), r the mean of the ratios of the last
    `width` places. The first bin of a cluster predicts 0 and does not refresh r, so that the
    second uses the mean up to two places before. At the very start r is the first ratio."""
    rows = numbered(rows, bins) if carry else rows.withColumn("i", F.col("bin"))
    w = _window(carry)
    near = F.avg("ratio").over(w.rowsBetween(-width, -1))
    older = F.avg("ratio").over(w.rowsBetween(-width - 1, -2))
    first = F.col("i") % bins == 0
    r = F.when(first, 0.0).when((F.col("i") % bins == 1) & (F.col("i") > 1), older).otherwise(near)
    out = rows.withColumn("r", r)
    out = out.withColumn("predicted", (F.col("given") * F.col("r")).cast("long"))
    return out.withColumn("error", F.when(first, 0).otherwise(F.abs(F.col("predicted") - F.col("value"))).cast("long"))


def mean_of_values(rows: DataFrame, bins: int, carry: bool = True) -> DataFrame:
    """The value before; the first predicts itself."""
    rows = numbered(rows, bins) if carry else rows
    out = rows.withColumn("predicted", F.coalesce(F.lag("value", 1).over(_window(carry)), F.col("value")).cast("long"))
    return out.withColumn("error", F.abs(F.col("predicted") - F.col("value")))


def weighted_values(rows: DataFrame, bins: int, carry: bool = True) -> DataFrame:
    """int((2 before + before that) / 3); the first two predict the first value."""
    rows = numbered(rows, bins) if carry else rows
    one, two = F.lag("value", 1).over(_window(carry)), F.lag("value", 2).over(_window(carry))
    out = rows.withColumn("predicted", F.coalesce(((one * 2 + two) / 3).cast("long"), one, F.col("value")).cast("long"))
    return out.withColumn("error", F.abs(F.col("predicted") - F.col("value")))


def weighted_ratios(rows: DataFrame, bins: int, carry: bool = True) -> DataFrame:
    """int(given * (2 ratio before + ratio before that) / 3); the first bin of a cluster predicts
    0. (Our definition, by analogy.)"""
    rows = numbered(rows, bins) if carry else rows.withColumn("i", F.col("bin"))
    one, two = F.lag("ratio", 1).over(_window(carry)), F.lag("ratio", 2).over(_window(carry))
    first = F.col("i") % bins == 0
    r = F.when(first, 0.0).otherwise(F.coalesce((one * 2 + two) / 3, one))
    out = rows.withColumn("r", r)
    out = out.withColumn("predicted", (F.col("given") * F.col("r")).cast("long"))
    return out.withColumn("error", F.when(first, 0).otherwise(F.abs(F.col("predicted") - F.col("value"))).cast("long"))


def _scanned(rows: DataFrame, carry: bool, first_of: int, predict) -> DataFrame:
    """With `predicted` and `error`: predict(rows of a sequence in order, whether each is the first
    bin of a cluster). Each prediction depends on the one before, so a sequence is one task; it
    reads it once."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        first = (pdf["i"] % first_of == 0).to_numpy()
        predicted = np.array(predict(pdf, first.tolist()), np.int64)
        error = np.where(first, 0, np.abs(predicted - pdf["value"].to_numpy()))
        return pdf[rows_columns].assign(predicted=predicted, error=error)

    rows_columns = rows.columns
    groups = rows.withColumn("__all", F.lit(0)).groupBy("__all") if carry else rows.groupBy("cluster")
    return groups.applyInPandas(one, f"{kinds}, predicted long, error long")


def exponential_ratios(rows: DataFrame, bins: int, alpha: float = 0.6, carry: bool = True) -> DataFrame:
    """int(given * r), then r = alpha r + (1 - alpha) ratio. The first bin of a cluster predicts 0
    and leaves r alone; r starts as the first ratio."""
    rows = numbered(rows, bins) if carry else rows.withColumn("i", F.col("bin"))

    def predict(pdf: pd.DataFrame, first: list[bool]) -> list[int]:
        out, r = [], None
        for start, given, ratio in zip(first, pdf["given"].tolist(), pdf["ratio"].tolist(), strict=True):
            r = ratio if r is None else r
            out.append(0 if start else int(given * r))
            if not start:
                r = r * alpha + ratio * (1 - alpha)
        return out

    return _scanned(rows.select("i", "cluster", "bin", "given", "value", "ratio"), carry, bins, predict)


def exponential_values(rows: DataFrame, bins: int, alpha: float = 0.3, carry: bool = True) -> DataFrame:
    """The state, then state = int(alpha state + (1 - alpha) value). The first bin of a cluster
    predicts 0 and leaves the state alone; the state starts as the first value."""
    rows = numbered(rows, bins) if carry else rows.withColumn("i", F.col("bin"))

    def predict(pdf: pd.DataFrame, first: list[bool]) -> list[int]:
        out, state = [], None
        for start, value in zip(first, pdf["value"].tolist(), strict=True):
            state = value if state is None else state
            out.append(0 if start else state)
            if not start:
                state = int(state * alpha + value * (1 - alpha))
        return out

    return _scanned(rows.select("i", "cluster", "bin", F.col("value").cast("long").alias("value")), carry, bins, predict)


def forecast_error(rows: DataFrame) -> DataFrame:
    """(mape, mse): mean error over mean value, and mean squared error."""
    mape = F.try_divide(F.avg("error"), F.avg("value"))
    return rows.agg(mape.alias("mape"), F.avg(F.col("error").cast("double") * F.col("error")).alias("mse"))


def peaks(series: DataFrame, height: float = 200) -> DataFrame:
    """Bins above a height that are higher than both neighbours."""
    w = W.partitionBy("cluster").orderBy("bin")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    near = series.withColumns({"before": before, "after": after})
    return near.where((F.col("value") > height) & (F.col("value") > F.col("before")) & (F.col("value") > F.col("after"))).drop("before", "after")


def spectrum_features(series: DataFrame, top: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """(cluster, n_peaks, f_0, f_2, f_4): local maxima of the amplitude spectrum, and the
    frequencies of the highest, third and fifth of them (0 where there are fewer). (Our rule.)
    A cluster's series is one task's array, which has one value per bin."""
    names = [f"f_{k}" for k in top]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("bin")["value"].to_numpy(float)
        power, freq = np.abs(np.fft.rfft(values)), np.fft.rfftfreq(len(values), 1)
        inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] > power[2:])) + 1
        order = inner[np.lexsort((inner, -power[inner]))]
        found = [float(freq[order[k]]) if k < len(order) else 0.0 for k in top]
        return pd.DataFrame([[pdf["cluster"].iloc[0], len(inner), *found]], columns=["cluster", "n_peaks", *names])

    kind = dict(series.dtypes)["cluster"]
    schema = f"cluster {kind}, n_peaks long, " + ", ".join(f"{n} double" for n in names)
    return series.groupBy("cluster").applyInPandas(one, schema)


def training_frame(series: DataFrame, centres: DataFrame, bins: int, per_day: int = 144) -> DataFrame:
    """ft_5 .. ft_1, place, weekday and the exponential forecast of each bin that has five before
    it, with its value. centres: (cluster, lat, lon)."""
    forecast = exponential_values(series, bins, carry=False).select("cluster", "bin", F.col("predicted").alias("exp_avg"))
    rows = lags(series).join(forecast, ["cluster", "bin"]).join(F.broadcast(centres), "cluster")
    return rows.withColumn("weekday", weekday("bin", per_day)).where(F.col("ft_5").isNotNull())


def time_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """With `part`: the first int(share * n) rows of each cluster by bin are train, others test."""
    w = W.partitionBy("cluster")
    nth = F.row_number().over(w.orderBy("bin"))
    cut = F.floor(F.count("*").over(w) * F.lit(share))
    return rows.withColumn("part", F.when(nth <= cut, "train").otherwise("test"))


