"""Anomaly detectors, trends, seasons and forecasts over ordered values of a key."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def z_score(df: DataFrame, key: str, order: list[str], value: str, window: int = 100, warm_up: int = 10, threshold: float = 3.0) -> DataFrame:
    """Adds z and is_anomaly, against the window of values before each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    n, mean, dev = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    z = F.when((n >= warm_up) & (dev > 0), (F.col(value) - mean) / dev)
    return df.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def iqr(df: DataFrame, key: str, order: list[str], value: str, window: int = 50, warm_up: int = 20, k: float = 1.5) -> DataFrame:
    """Adds q1, q3 (at n / 4 and 3n / 4 of the sorted window before) and is_anomaly."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    held = df.withColumn("_s", F.sort_array(F.collect_list(value).over(w)))
    at = lambda q: F.when(F.size("_s") >= warm_up, F.get("_s", F.floor(F.size("_s") * q / 4).cast("int")))
    out = held.withColumn("q1", at(1)).withColumn("q3", at(3)).drop("_s")
    wide = (F.col("q3") - F.col("q1")) * k
    return out.withColumn("is_anomaly", F.coalesce((F.col(value) < F.col("q1") - wide) | (F.col(value) > F.col("q3") + wide), F.lit(False)))


def smoothed(df: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """Adds _i (place in the key, from 0), _before and _var (exponential mean and variance before the row) and _mean (after it).

    mean' = mean + alpha * d and var' = (1 - alpha) * (var + alpha * d * d) for d = value - mean, from the key's first value
    and 0. A key may span tasks: rows are dealt to ranges of (key, order), each read once from its own first value; what the
    range before would have added is linear in its variance and quadratic in the difference c of the means, so it follows
    from three more sums a row and one row a range. A null or NaN value makes all that follows in its key NaN.
    """
    names, spark = df.columns, df.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    extra = ["_part", "_first", "_i", "_before", "_var", "_mean", "_w", "_u", "_end", "_x"]
    q, of, at = 1 - alpha, names.index(key), names.index(value)

    def local(batches):
        part = TaskContext.get().partitionId()
        now, started, opened, i = None, False, True, 0
        for batch in batches:
            out = []
            keys, values = batch.column(of).to_pylist(), batch.column(at).cast("double").to_pylist()
            for k, v in zip(keys, values):
                v = float("nan") if v is None else v
                if not started or k != now:
                    opened, started, now, i, x, mean, var, w, u = not started, True, k, 0, v, v, 0.0, 0.0, 0.0
                d, far = v - mean, q**i
                row = [part, opened, i, mean, var, mean + alpha * d, w, u]
                mean, var = mean + alpha * d, q * (var + alpha * d * d)
                if opened:  # what c times and c * c times add to the variance
                    w, u = q * (w + alpha * far * d), q * (u + alpha * far * far)
                out.append((*row, var, x, w, u))
                i += 1
            made = [pa.array(c) for c in zip(*out)] or [pa.array([], pa.null())] * 12
            kinds = [pa.int32(), pa.bool_(), pa.int64()] + [pa.float64()] * 9
            yield pa.RecordBatch.from_arrays([*batch.columns, *[c.cast(t) for c, t in zip(made, kinds)]], [*names, *extra, "_wend", "_uend"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    path = scratch_path(spark, "smoothed")
    doubles = ", ".join(f"{c} double" for c in [*extra[3:], "_wend", "_uend"])
    ranged.mapInArrow(local, f"{fields}, _part int, _first boolean, _i long, {doubles}").write.parquet(path)
    held = spark.read.parquet(path)

    ends = held.groupBy("_part", "_first", F.col(key).alias("k")).agg(F.max("_i").alias("last"), F.max_by(F.struct("_mean", "_end", "_wend", "_uend", "_x"), "_i").alias("e"))
    one = Window.partitionBy("_part", "_first").orderBy(F.desc("k"))  # a range's first key, and the last of its others
    edges = ends.withColumn("r", F.row_number().over(one)).where("r = 1").orderBy("_part", F.desc("_first")).collect()  # two rows a range at most
    carried, before = [], None
    for e in edges:
        mean, var = e.e["_mean"], e.e["_end"]
        if e["_first"]:
            same = before is not None and before[0] == e.k
            if same:
                c, long = before[1] - e.e["_x"], q ** (e["last"] + 1)
                var += -2 * c * e.e["_wend"] + c * c * e.e["_uend"] + before[2] * long
                mean += c * long
            carried.append((e["_part"], c if same else 0.0, before[2] if same else 0.0, before[3] if same else 0))
            before = (e.k, mean, var, (before[3] if same else 0) + e["last"] + 1)
        else:
            before = (e.k, mean, var, e["last"] + 1)
    met = spark.createDataFrame(carried, "_part int, _c double, _v double, _n long")  # a row a range
    out = held.join(F.broadcast(met), "_part", "left")
    far = F.pow(F.lit(q), F.col("_i"))
    move = F.col("_first") & (F.col("_n") > 0)
    var = F.col("_var") - 2 * F.col("_c") * F.col("_w") + F.col("_c") * F.col("_c") * F.col("_u") + F.col("_v") * far
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(move, F.col("_i") + F.col("_n")).otherwise(F.col("_i")).alias("_i"),
        F.when(move, F.col("_before") + F.col("_c") * far).otherwise(F.col("_before")).alias("_before"),
        F.when(move, F.greatest(var, F.lit(0.0))).otherwise(F.col("_var")).alias("_var"),
        F.when(move, F.col("_mean") + F.col("_c") * far * q).otherwise(F.col("_mean")).alias("_mean"),
    )


def ema(df: DataFrame, key: str, order: list[str], value: str, window: int = 20, threshold: float = 3.0, warm_up: int = 10) -> DataFrame:
    """Adds ema (the mean after the row, alpha 2 / (window + 1)) and is_anomaly."""
    out = smoothed(df, key, order, value, 2 / (window + 1))
    far = F.abs(F.col(value) - F.col("_before")) > threshold * F.sqrt("_var")
    odd = (F.col("_i") >= warm_up) & (F.col("_var") > 0) & far & ~F.isnan("_var")
    return out.select(*df.columns, F.col("_mean").alias("ema"), F.coalesce(odd, F.lit(False)).alias("is_anomaly"))


def ewma(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, sensitivity: float = 3.0, least: int = 10) -> DataFrame:
    """Adds deviation (from the weighted mean before the row, in deviations; null before `least` rows or without any) and
    is_anomaly."""
    out = smoothed(df, key, order, value, alpha)
    usable = (F.col("_i") >= least) & (F.col("_var") > 0) & ~F.isnan("_var")
    out = out.withColumn("deviation", F.when(usable, F.abs(F.col(value) - F.col("_before")) / F.sqrt("_var")))
    return out.select(*df.columns, "deviation", F.coalesce(F.col("deviation") > sensitivity, F.lit(False)).alias("is_anomaly"))


def local_outliers(df: DataFrame, key: str, order: list[str], value: str, window: int = 50, k: int = 5, ratio: float = 2.0, warm_up: int = 10) -> DataFrame:
    """Adds lof, the distance to the k-th nearest value of the window before over the mean distance to the k nearest (1 if
    that is 0, null before `warm_up` values), and is_anomaly."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    held = df.withColumn("_d", F.slice(F.sort_array(F.transform(F.collect_list(value).over(w), lambda x: F.abs(x - F.col(value)))), 1, k)).withColumn("_n", F.count(value).over(w))
    mean = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / F.size("_d")
    lof = F.when(F.col("_n") >= warm_up, F.when(mean > 0, F.element_at("_d", -1) / mean).otherwise(F.lit(1.0)))
    return held.withColumn("lof", lof).drop("_d", "_n").withColumn("is_anomaly", F.coalesce(F.col("lof") > ratio, F.lit(False)))


def isolation(df: DataFrame, key: str, order: list[str], value: str, window: int = 50, least: float = 0.1, warm_up: int = 10) -> DataFrame:
    """Adds isolation, the share of the window's values beyond its mean from the value and smaller in size (null before
    `warm_up` values), and is_anomaly: under `least`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    held = df.withColumn("_s", F.collect_list(value).over(w)).withColumn("_m", F.avg(value).over(w))
    side = lambda x: F.when(x >= 0, 1).otherwise(-1)
    far = F.size(F.filter("_s", lambda x: (side(F.col("_m") - F.col(value)) != side(F.col("_m") - x)) & (F.abs(x) < F.abs(F.col(value)))))
    held = held.withColumn("isolation", F.when(F.size("_s") >= warm_up, far / F.size("_s"))).drop("_s", "_m")
    return held.withColumn("is_anomaly", F.coalesce(F.col("isolation") < least, F.lit(False)))


def holt(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.5, beta: float = 0.3, ahead: int = 1) -> DataFrame:
    """Double exponential smoothing: level, trend and forecast after each row. Null from a key's first null value on.

    Rows are read in order of (key, order) as a stream, so that a key of any length fits; one key is read in one task.
    """
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    of, at = names.index(key), names.index(value)

    def run(batches):
        now, started, level, slope = None, False, None, None
        for batch in batches:
            out = []
            for k, v in zip(batch.column(of).to_pylist(), batch.column(at).cast("double").to_pylist()):
                if not started or k != now and (k == k or now == now):  # NaN keys are one
                    started, now, level, slope = True, k, v, 0.0
                elif v is None or level is None:
                    level = slope = None
                else:
                    was = level
                    level = alpha * v + (1 - alpha) * (level + slope)
                    slope = beta * (level - was) + (1 - beta) * slope
                out.append((level, slope, None if level is None else level + ahead * slope))
            made = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.float64()) for c in made]], [*names, "level", "trend", "forecast"])

    ranked = df.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])
    return ranked.mapInArrow(run, f"{fields}, level double, trend double, forecast double")


def trend(df: DataFrame, key: str, order: list[str], value: str, flat: float = 0.01) -> DataFrame:
    """key, slope, direction: least squares over the row number, relative to the mean."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("double")
    got = df.withColumn("_x", n).groupBy(key).agg(F.regr_slope(F.col(value), F.col("_x")).alias("slope"), F.avg(value).alias("_m"))
    share = F.col("slope") / F.abs("_m")
    return got.withColumn("direction", F.when(share > flat, "up").when(share < -flat, "down").otherwise("flat")).drop("_m")


def seasons(df: DataFrame, key: str, order: list[str], value: str, shortest: int = 2, longest: int = 64, least: float = 0.5, top: int = 3) -> DataFrame:
    """key, period, correlation: the `top` strongest autocorrelations above `least`, for keys of three periods or more and
    periods up to half a key's values. Each lag's products are summed, and divided by their number and the variance."""
    w, every = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    lags = range(shortest, longest + 1)
    x = df.where(F.col(value).isNotNull()).select(key, *order, (F.col(value) - F.avg(value).over(every)).alias("_d"))
    x = x.select(key, "_d", *[F.lag("_d", p).over(w).alias(f"_l{p}") for p in lags])
    sums = x.groupBy(key).agg(F.count("*").alias("_n"), F.avg(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{p}")).alias(f"_s{p}") for p in lags])
    rows = F.array(*[F.struct(F.lit(p).cast("long").alias("period"), (F.col(f"_s{p}") / (F.col("_n") - p) / F.col("_v")).alias("correlation")) for p in lags])
    found = sums.where((F.col("_n") >= 3 * shortest) & (F.col("_v") > 0)).select(key, "_n", F.explode(rows).alias("_r")).select(key, "_n", "_r.*")
    found = found.where((F.col("period") <= F.floor(F.col("_n") / 2)) & (F.col("correlation") > least))
    best = Window.partitionBy(key).orderBy(F.desc("correlation"), "period")
    return found.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= top).select(key, "period", "correlation")
