"""Model ranking on pyspark.ml: boosted trees on rank-normalised labels, seeded search, stacking."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import pct_rank
from quantloom.functions.session import dealt, materialised
from quantloom.operators.validation import fold_dates, ndcg, prune_by_ic, rank_ic, stack_ridge, walk_forward


def with_target(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds target, the label's percentile on its date: a pointwise stand-in for a ranking loss."""
    return dealt(df.where(F.col(label).isNotNull()), "date").withColumn("target", pct_rank(label, "date"))


def training_matrix(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("market", "date", "symbol")) -> DataFrame:
    """The labelled rows as keys, x (array of float, one entry a feature) and label (float)."""
    rows = df.where(F.col("label").isNotNull())
    return rows.select(*keys, F.array(*(F.col(f).cast("float") for f in features)).alias("x"), F.col("label").cast("float").alias("label"))


def matrix_groups(df: DataFrame, features: list[str]) -> DataFrame:
    """market, date, n, ends (rows up to the group's last one), and sums of label and features.

    A group is what is ranked together.  One row a group is ordered in one task.
    """
    rows = df.where(F.col("label").isNotNull())
    groups = rows.groupBy("market", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("sum_label"), *(F.sum(f).alias(f"sum_{f}") for f in features))
    ends = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("market", "date"))
    return groups.withColumn("ends", ends)


def ranker(features: list[str], kind: str = "gbt", seed: int = 7, **params) -> Pipeline:
    model = (GBTRegressor if kind == "gbt" else RandomForestRegressor)(featuresCol="features", labelCol="target", predictionCol="pred_ret", seed=seed, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), model])


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], kind: str = "gbt", **params) -> DataFrame:
    model = ranker(features, kind, **params).fit(with_target(train))
    return model.transform(test).drop("features")


def search(pairs: list[tuple[DataFrame, DataFrame]], features: list[str], trials: int = 15, seed: int = 7) -> list[tuple[float, dict]]:
    """Seeded random search over depth, step and share, the best mean NDCG@5 over the (train, test) pairs first."""
    rng = random.Random(seed)
    found = []
    for _ in range(trials):
        params = {"maxDepth": rng.randint(2, 6), "stepSize": 10 ** rng.uniform(-2, -0.5), "subsamplingRate": rng.uniform(0.5, 1.0), "maxIter": rng.choice([10, 20, 40])}
        values = [mean_ndcg(fit_predict(past, coming, features, **params), 5) for past, coming in pairs]
        found.append((sum(values) / len(values), params))
    return sorted(found, key=lambda x: -x[0])


def mean_ndcg(predictions: DataFrame, k: int) -> float:
    return ndcg(predictions, k).agg(F.avg("ndcg")).first()[0] or 0.0


@dataclass
class Trained:
    """The best fold's two models with their stacking weights, and how they came about."""

    boosted: PipelineModel
    forest: PipelineModel
    weights: tuple[float, float]
    features: list[str]
    fold: int
    ndcg: float
    params: dict

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds pred_ret, the weighted predictions (the intercept moves no rank and is left out)."""
        out = _both(self.boosted, self.forest, rows)
        return out.withColumn("pred_ret", F.col("_boosted") * self.weights[0] + F.col("_forest") * self.weights[1]).drop("_boosted", "_forest")


def _both(boosted: PipelineModel, forest: PipelineModel, rows: DataFrame) -> DataFrame:
    for model, name in ((boosted, "_boosted"), (forest, "_forest")):
        rows = model.transform(rows).drop("features").withColumnRenamed("pred_ret", name)
    return rows


def train(
    panel: DataFrame, features: list[str], folds: int = 3, embargo: int = 5, threshold: float = 0.01, least: int = 30, trials: int = 0, least_rows: int = 500, seed: int = 7, **params
) -> Trained | None:
    """Prunes features, searches parameters, fits each fold and stacks the best one's models.

    None if there are fewer labelled rows than ``least_rows`` or no fold has rows on both sides.
    Validation follows training by ``embargo`` dates in every fold.
    """
    rows = materialised(panel.where(F.col("label").isNotNull()))
    if rows.count() < least_rows:
        return None
    kept = {r.name for r in prune_by_ic(rank_ic(rows, features), threshold, least).where("kept").collect()}  # one row a feature
    chosen = [f for f in features if f in kept]
    dated = rows.join(F.broadcast(fold_dates(rows, folds, embargo)), "date")  # a row a date and fold
    sides = {i: tuple(dated.where((F.col("fold") == i) & (F.col("part") == part)).drop("fold", "part", "tail") for part in ("train", "val")) for i in range(1, folds + 1)}
    sides = {i: pair for i, pair in sides.items() if not pair[0].isEmpty() and not pair[1].isEmpty()}
    if not chosen or not sides:
        return None
    if trials:
        params = search(list(sides.values())[:2], chosen, trials, seed)[0][1] | params
    fitted = {i: ranker(chosen, seed=seed, **params).fit(with_target(past)) for i, (past, _) in sides.items()}
    values = {i: mean_ndcg(fitted[i].transform(coming).drop("features"), 10) for i, (_, coming) in sides.items()}
    best = max(values, key=lambda i: (values[i], i))
    past = sides[best][0]
    forest = ranker(chosen, "forest", seed).fit(with_target(past))
    ridge = stack_ridge(_both(fitted[best], forest, past), "_boosted", "_forest").first()
    weights = (ridge.w1, ridge.w2) if ridge.w1 or ridge.w2 else (0.5, 0.5)
    return Trained(fitted[best], forest, weights, chosen, best, values[best], params)


def walk_forward_fit(panel: DataFrame, features: list[str], train_dates: int = 504, step: int = 5, least_rows: int = 500, **params) -> DataFrame | None:
    """Predictions of a model fitted anew for each window, put together; windows with too few rows are left out.

    One fit a window: the loop is over windows, whose number is that of dates by ``step``.
    """
    rows = materialised(panel.where(F.col("label").isNotNull()))
    out = None
    for w in walk_forward(rows, train_dates, step).orderBy("start").collect():
        past = rows.where(F.col("date").between(w.train_first, w.train_last))
        if past.count() < least_rows:
            continue
        found = fit_predict(past, rows.where(F.col("date").between(w.test_first, w.test_last)), features, **params).withColumn("start", F.lit(w.start))
        out = found if out is None else out.unionByName(found)
    return out


def importance(model: PipelineModel, features: list[str], n: int = 10) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: -x[1])[:n]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def should_retrain(age_days: int | None, most: int = 5) -> bool:
    """Without a model, or with one of ``most`` days or more."""
    return age_days is None or age_days >= most
