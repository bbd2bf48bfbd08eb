"""Queries of model fitting: ranking gradients, Newton trees, boosting, sliding fits, the matrix, learned sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.session import Tables
from quantloom.operators import boosting, models, sentiment, text, validation
from quantloom.plans import queries as base
from quantloom.sources import views

Query = Callable[[SparkSession, str], DataFrame]
GROUP = ("market", "date")
STUMP = boosting.Settings(objective="squared", depth=1, l1=0.05, l2=1.0, feature_share=1.0, row_share=1.0)

_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._labelled(spark, sf_dir).where("label IS NOT NULL").select("market", "date", "symbol", "label", *base.FEATURES)


@_query
def rank_gradients(spark, sf_dir):
    """What the first round of the ranking loss gives each row."""
    rows = boosting.graded(_rows(spark, sf_dir).withColumn("score", F.lit(0.0)), by=GROUP)
    return base.rounded(boosting.rank_gradients(rows, by=GROUP).select(*GROUP, "symbol", "rel", "g", "h"))


@_query
def newton_stump(spark, sf_dir):
    """The first tree of depth one on squared error, with its penalised leaf values."""
    rows = _rows(spark, sf_dir)
    cuts = boosting.spread_cuts(rows, base.FEATURES)
    table = boosting.squared_gradients(boosting.binned(rows.withColumn("score", F.lit(0.0)), base.FEATURES, cuts))
    tree = boosting.grow(table, list(range(len(base.FEATURES))), STUMP)
    table = table.select(F.explode(F.array(F.lit(1)) if not tree.splits else F.array(F.lit(1), tree.node())).alias("node"), "label")
    named = {i: (base.FEATURES[f], float(cuts[f][at - 1]) if at else None) for i, (f, at) in tree.splits.items()}
    of = lambda pick, kind: F.coalesce(*(F.when(F.col("node") == i, F.lit(pick(x))) for i, x in named.items()), F.lit(None)).cast(kind)
    value = F.coalesce(*(F.when(F.col("node") == i, F.lit(v)) for i, v in tree.values.items()), F.lit(0.0))
    found = table.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return base.rounded(found.select(F.col("node").cast("long").alias("node"), "n", of(lambda x: x[0], "string").alias("feature"), of(lambda x: x[1], "double").alias("cut"), value.alias("value")))


@_query
def rank_boost(spark, sf_dir):
    """Listwise boosting with the library's settings, judged by NDCG on the last fifth of the dates."""
    rows = Tables(spark, "rank_boost").write(_rows(spark, sf_dir), "rows")  # read for the cut, the bins and both sides
    cut = rows.agg(F.percentile_approx(F.unix_date("date"), 0.8).alias("c")).first()["c"]
    if cut is None:
        return spark.createDataFrame([], "date date, ndcg double")
    past, coming = rows.where(F.unix_date("date") <= cut), rows.where(F.unix_date("date") > cut)
    return validation.ndcg(boosting.boost(past, coming, base.FEATURES, by=GROUP).predict(coming))


@_query
def wfa_normal(spark, sf_dir):
    """Two features fitted together, on windows that slide over sums by date."""
    xs = ["close_ma_5_ratio", "momentum_10d"]
    found = validation.walk_forward_normal(_rows(spark, sf_dir), xs, "label", base.TRAIN, base.STEP)
    return base.rounded(found.select("symbol", "date", "start", "pred_ret"))


@_query
def training_matrix(spark, sf_dir):
    """The matrix's groups in order, with their sizes, ends and sums of features."""
    return base.rounded(models.matrix_groups(base._labelled(spark, sf_dir), base.FEATURES))


#: Words that occur in the invented prose, as negations and words of degree.
SCOPES = {"negations": ["ion"], "stronger": ["the"], "weaker": ["and"]}


def _learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the classes of those that are labelled, and all documents' words."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = views.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return docs, classes, sentiment.weighted_words(docs, "doc_id", sentiment.tokens(F.col("text")), **SCOPES)


@_query
def bayes_counts(spark, sf_dir):
    """Word weights by class over all labelled documents."""
    _, classes, words = _learned(spark, sf_dir)
    return sentiment.class_counts(words, classes, "doc_id")


@_query
def bayes_scores(spark, sf_dir):
    """Every document's learned score, and what the lexicon makes of it as its base."""
    docs, classes, words = _learned(spark, sf_dir)
    found = sentiment.bayes_scores(words, sentiment.class_counts(words, classes, "doc_id"), docs, classes, "doc_id")
    scored = docs.join(found, "doc_id").withColumn("boosted", text.lexicon_boost(F.coalesce("text", F.lit("")), F.col("score"), base.POSITIVE, base.NEGATIVE))
    return base.rounded(scored.select("doc_id", "log_odds", "score", "boosted"))


def queries() -> dict[str, Query]:
    return dict(_found)
