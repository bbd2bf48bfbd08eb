"""Leak-aware validation: folds, walk-forward windows, rank correlation, ranking quality, stacking."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import EPS, pct_rank
from quantloom.functions.session import materialised, running_total, tasks_of


def query_groups(df: DataFrame) -> DataFrame:
    return df.groupBy("market", "date").agg(F.count(F.lit(1)).alias("n"))


def date_index(df: DataFrame) -> DataFrame:
    """date, at (from 0) and n_dates.  One row a date, ordered in one task."""
    dates = df.select("date").distinct()
    whole = Window.partitionBy(F.lit(0))
    return dates.select("date", (F.row_number().over(whole.orderBy("date")) - 1).cast("long").alias("at"), F.count(F.lit(1)).over(whole).alias("n_dates"))


def fold_dates(df: DataFrame, folds: int = 3, embargo: int = 5) -> DataFrame:
    """fold, date, part: the dates of each expanding training window and its validation window."""
    index = date_index(df).withColumn("size", F.floor(F.col("n_dates") / (folds + 1)))
    each = index.withColumn("fold", F.explode(F.array(*(F.lit(i) for i in range(1, folds + 1)))))
    start = F.col("fold") * F.col("size")
    part = F.when(F.col("at") < start, "train").when((F.col("at") >= start + embargo) & (F.col("at") < start + embargo + F.col("size")), "val")
    return each.withColumn("part", part).where("part IS NOT NULL").withColumn("tail", F.col("at") - start).select("fold", "date", "part", "tail")


def cv_folds(df: DataFrame, folds: int = 3, embargo: int = 5, least_train: int = 100, least_val: int = 10) -> DataFrame:
    rows = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(fold_dates(df, folds, embargo)), "date")  # a row a date
    of = lambda p, x: F.when(F.col("part") == p, F.col(x))
    table = rows.groupBy("fold").agg(
        F.sum(of("train", "n")).alias("train_rows"), F.sum(of("val", "n")).alias("val_rows"), F.max(of("train", "date")).alias("train_last"), F.min(of("val", "date")).alias("val_first"), F.max(of("val", "date")).alias("val_last")
    )
    return table.where((F.col("train_rows") >= least_train) & (F.col("val_rows") >= least_val))


def purged(df: DataFrame, folds: int = 3, embargo: int = 5, seen_dates: int = 5) -> DataFrame:
    """fold and the validation rows of symbols that the last training dates do not have."""
    dates = fold_dates(df, folds, embargo)
    rows = df.join(F.broadcast(dates), "date")
    seen = rows.where((F.col("part") == "train") & (F.col("tail") >= -seen_dates)).select("fold", "symbol").distinct()
    return rows.where("part = 'val'").join(seen, ["fold", "symbol"], "left_anti")


def walk_forward(df: DataFrame, train: int = 504, step: int = 5) -> DataFrame:
    """start, first and last dates of each training window and of the dates predicted by it."""
    index = date_index(df)
    starts = index.where((F.col("at") % step == 0) & (F.col("at") < F.col("n_dates") - train)).select(F.col("at").alias("start"))
    near = index.join(F.broadcast(starts), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + train + step))
    past = F.col("at") < F.col("start") + train
    return near.groupBy("start").agg(
        F.min(F.when(past, F.col("date"))).alias("train_first"), F.max(F.when(past, F.col("date"))).alias("train_last"), F.min(F.when(~past, F.col("date"))).alias("test_first"), F.max(F.when(~past, F.col("date"))).alias("test_last")
    )


def walk_forward_linear(df: DataFrame, x: str, y: str, train: int = 504, step: int = 5) -> DataFrame:
    """Predictions of a linear model that is fitted anew for each window.

    Moments are summed by date first, so a window costs its dates and not its rows.
    """
    df = materialised(df)  # read for the dates, the moments and the rows to predict
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x), F.col(y)
    moments = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    windows = walk_forward(df, train, step)
    fits = moments.join(F.broadcast(windows), (F.col("date") >= F.col("train_first")) & (F.col("date") <= F.col("train_last"))).groupBy("start", "test_first", "test_last")
    fits = fits.agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when(spread > EPS, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / spread).otherwise(0.0)
    fits = fits.withColumn("slope", slope).withColumn("intercept", F.col("sy") / F.col("n") - F.col("slope") * F.col("sx") / F.col("n"))
    fits = fits.select("start", "test_first", "test_last", "slope", "intercept")
    tested = df.join(F.broadcast(fits), (F.col("date") >= F.col("test_first")) & (F.col("date") <= F.col("test_last")))
    return tested.withColumn("pred_ret", F.col("slope") * a + F.col("intercept"))


def average_ranks(counts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds rank, over the whole table, to the distinct values (name, value, _n) of each name; ties at their mean."""
    ranked = running_total(counts, ["name", "value"], "_n", "_before", tasks)
    first = ranked.groupBy("name").agg(F.min("_before").alias("_first"))
    rank = F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2.0
    return ranked.join(F.broadcast(first), "name").withColumn("rank", rank).drop("_before", "_first")


def rank_ic(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """name, ic, n: Spearman correlation of each feature with the label.

    The label's ranks are joined to the rows once, for features without nulls; those with nulls have
    ranks of their own rows.  Then a feature's distinct values with sums of their rows' label ranks
    are ranked, so no rows are joined to the features' ranks.  Ranks are taken about their known mean.
    """
    tasks = tasks_of(df)
    rows = materialised(df.where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), *features))  # read for counts, ranks and rows
    held = rows.agg(F.count(F.lit(1)), *(F.count(f) for f in features)).first()  # a number a feature
    of = dict(zip(features, held[1:], strict=True))
    whole, holed = [f for f in features if of[f] == held[0]], [f for f in features if of[f] < held[0]]
    tied = lambda long: average_ranks(long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n")), tasks).select("name", F.col("value").alias("_y"), F.col("rank").alias("_ry"))
    pairs = []
    if whole:
        ranks = tied(rows.select(F.lit("").alias("name"), F.col("_y").alias("value"))).drop("name")
        pairs.append(rows.select("_y", *whole).join(ranks, "_y").unpivot(["_ry"], whole, "name", "value"))
    if holed:
        long = rows.unpivot(["_y"], holed, "name", "value").where("value IS NOT NULL")
        pairs.append(long.join(tied(long.select("name", F.col("_y").alias("value"))), ["name", "_y"]).select("_ry", "name", "value"))
    middle = F.coalesce(*(F.when(F.col("name") == f, F.lit((n + 1) / 2.0)) for f, n in of.items()))
    apart = F.col("_ry") - middle
    per = reduce(DataFrame.unionByName, pairs).groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n"), F.sum(apart).alias("_sy"), F.sum(apart * apart).alias("_syy"))
    x = F.col("rank") - middle
    n = F.sum("_n")
    xx, xy, yy = F.sum(F.col("_n") * x * x) / n, F.sum(x * F.col("_sy")) / n, F.sum("_syy") / n
    spread = F.sqrt(xx) * F.sqrt(yy)
    return average_ranks(per, tasks).groupBy("name").agg(F.when(spread > EPS, xy / spread).otherwise(0.0).alias("ic"), n.alias("n"))


def p_value(t: float | None, freedom: float) -> float | None:
    """Two-sided tail of Student's t: the incomplete beta function at freedom / (freedom + t * t)."""
    if t is None or freedom <= 0:
        return None
    x, a, b = freedom / (freedom + t * t), freedom / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - _beta_tail(1.0 - x, b, a)
    return _beta_tail(x, a, b)


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction, evaluated from the end."""
    if x <= 0.0:
        return 0.0
    value = 1.0
    for n in range(200, 0, -1):
        half = n // 2
        step = half * (b - half) * x / ((a + n - 1) * (a + n)) if n % 2 == 0 else -(a + half) * (a + b + half) * x / ((a + n - 1) * (a + n))
        value = 1.0 + step / value
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / (a * value)


def with_p_values(report: DataFrame) -> DataFrame:
    """Adds p_value to ``ic_report``: a small function over one row a feature."""
    tail = F.udf(p_value, "double")
    return report.withColumn("p_value", tail("t_stat", (F.col("n") - 2).cast("double")))


def ic_report(ics: DataFrame, least: int = 10) -> DataFrame:
    """Adds t_stat, the correlation by its error at n - 2 degrees; with too few rows both are 0.  One row a feature."""
    enough = (F.col("n") >= least) & (F.abs("ic") < 1)
    t = F.when(enough, F.col("ic") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(EPS)))).otherwise(0.0)
    return ics.withColumns({"t_stat": t, "ic": F.when(F.col("n") >= least, F.col("ic")).otherwise(0.0)})


def prune_by_ic(ics: DataFrame, threshold: float = 0.01, least: int = 30) -> DataFrame:
    """Adds kept: over the threshold, or among the ``least`` best.  One row a feature."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("ic")), "name"))
    return ics.withColumn("kept", (F.abs("ic") >= threshold) | (place <= least))


def ndcg(df: DataFrame, k: int = 10, grades: int = 5) -> DataFrame:
    """date, ndcg: graded by the label's percentile on that date."""
    graded = df.where("label IS NOT NULL").withColumn("rel", F.least(F.lit(grades - 1), F.floor(pct_rank("label", "date") * grades)).cast("double"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    got, best = Window.partitionBy("date").orderBy(F.desc("pred_ret"), "symbol"), Window.partitionBy("date").orderBy(F.desc("rel"), "symbol")
    graded = graded.withColumns({"a": F.row_number().over(got), "b": F.row_number().over(best)})
    part = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sums = graded.groupBy("date").agg(part("a").alias("dcg"), part("b").alias("ideal"))
    return sums.select("date", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def stack_ridge(df: DataFrame, x1: str, x2: str, y: str = "label", alpha: float = 1.0) -> DataFrame:
    """w1, w2, intercept of the ridge of y on two predictions, in closed form from one aggregate."""
    rows = df.where(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    m = rows.agg(
        n.alias("n"),
        *(F.avg(c).alias(f"m_{i}") for i, c in enumerate((x1, x2, y))),
        (F.var_pop(x1) * n + alpha).alias("a"),
        (F.var_pop(x2) * n + alpha).alias("b"),
        (F.covar_pop(x1, x2) * n).alias("c"),
        (F.covar_pop(x1, y) * n).alias("d"),
        (F.covar_pop(x2, y) * n).alias("e"),
    )
    return m.selectExpr("n", "(b * d - c * e) / (a * b - c * c) AS w1", "(a * e - c * d) / (a * b - c * c) AS w2", "m_0", "m_1", "m_2").selectExpr("n", "w1", "w2", "m_2 - w1 * m_0 - w2 * m_1 AS intercept")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each date of a batch the sums of products of (1, x.., y) over its complete rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        days = batch.column(0).cast(pa.int32()).to_numpy()
        columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(1, batch.num_columns)]
        z = np.column_stack([np.ones(batch.num_rows), *columns])
        z[~np.isfinite(z).all(1)] = 0.0
        found, place = np.unique(days, return_inverse=True)
        sums = np.zeros((len(found), z.shape[1] ** 2))
        for i in range(len(found)):
            own = z[place == i]
            sums[i] = (own.T @ own).ravel()
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), lists], names=["day", "sums"])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.array(x) for x in table.column("sums").to_pylist()], axis=0)
    return pa.table({"day": pa.array([table.column("day")[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()])})


def sliding_fits(sums: DataFrame, p: int, train: int, step: int, ridge: float) -> DataFrame:
    """day, start, slopes, intercept: the fit that holds on each day, from one row of sums a date.

    Dates pass once, in order: each is added to the window's matrix on entry and subtracted
    on exit, so a window costs ``step`` additions and one solution, however many rows or dates it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[np.ndarray] = deque()
        window, at, fit = np.zeros((p + 2, p + 2)), 0, None
        for batch in batches:
            out = []
            for day, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at >= train and (at - train) % step == 0:
                    fit = (at - train, *_solved(window, p, ridge))
                if fit:
                    out.append((day, *fit))
                held.append(np.array(flat).reshape(p + 2, p + 2))
                window = window + held[-1]
                if len(held) > train:
                    window = window - held.popleft()
                at += 1
            if out:
                days, starts, slopes, intercepts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(days, pa.int32()), pa.array(starts, pa.int64()), pa.array(slopes), pa.array(intercepts)], names=["day", "start", "slopes", "intercept"])

    return sums.coalesce(1).sortWithinPartitions("day").mapInArrow(run, "day int, start long, slopes array<double>, intercept double")


def _solved(window: np.ndarray, p: int, ridge: float) -> tuple[list[float], float]:
    n = window[0, 0]
    if n < 1:
        return [0.0] * p, 0.0
    means = window[0, 1:] / n
    centred = window[1:, 1:] - n * np.outer(means, means)
    slopes = np.linalg.lstsq(centred[:p, :p] + ridge * np.eye(p), centred[:p, p], rcond=1e-12)[0]
    return slopes.tolist(), float(means[p] - slopes @ means[:p])


def walk_forward_normal(df: DataFrame, xs: list[str], y: str, train: int = 504, step: int = 5, ridge: float = 0.0) -> DataFrame:
    """Adds start and pred_ret: linear models of all features, fitted anew for each window.

    Features and label are taken relative to their means over the whole table, so that little
    is lost where sums are subtracted; rows with a missing value do not count in fits and
    have no prediction.  The sums of a date are one row whatever its rows.
    """
    df = materialised(df)
    names = [*xs, y]
    centre = df.agg(*(F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"m{i}") for i, c in enumerate(names))).first()
    centre = [c or 0.0 for c in centre]
    rows = df.select("date", *((F.col(c).cast("double") - m).alias(f"z{i}") for i, (c, m) in enumerate(zip(names, centre, strict=True))))
    sums = rows.mapInArrow(_products, "day int, sums array<double>").groupBy("day").applyInArrow(_added, "day int, sums array<double>")
    fits = sliding_fits(sums, len(xs), train, step, ridge).withColumn("date", F.date_from_unix_date("day")).drop("day")
    linear = F.col("intercept") + centre[-1]
    for i, c in enumerate(xs):
        linear = linear + F.col("slopes")[i] * (F.col(c) - centre[i])
    return df.join(F.broadcast(fits), "date").withColumn("pred_ret", linear).drop("slopes", "intercept")  # a row a date
