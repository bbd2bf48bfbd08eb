"""Steps over the panel whose shuffles, joins and sorts do not multiply its rows."""

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import session
from quantloom.operators import boosting, preprocess, sentiment, validation
from quantloom.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_by_date_are_not_stacked(spark):
    df = spark.createDataFrame([("US", "a", 1, 1.0, None), ("US", "b", 1, 1.0, 2.0), ("US", "c", 1, -3.0, 2.0)], "market string, symbol string, date int, x double, y double")
    out = preprocess.cross_sectional_rank(df, ["x", "y"])
    assert plan(out).count("Exchange") == 1 and "Expand" not in plan(out)
    assert [(r.x, r.y) for r in out.orderBy("symbol").collect()] == [(2.5 / 3, 0.5), (2.5 / 3, 0.75), (1 / 3, 0.75)]


def test_gradients_pass_in_order_without_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(d, f"s{i:03}", float(rng.normal()), float(rng.integers(0, 5)), 9.0) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "date int, symbol string, score double, rel double, ideal double")
    want = {(r.date, r.symbol): (r.g, r.h) for r in boosting.rank_gradients(df, 4).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    found = boosting.rank_gradients(df, 4)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    got = {(r.date, r.symbol): (r.g, r.h) for r in found.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(want) and len(got) == 120
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_quantiles_order_a_bracket_only(spark, monkeypatch):
    x = np.random.default_rng(6).normal(0, 1, 50_000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.abs(x)}))
    monkeypatch.setattr(preprocess, "_ordered_quantiles", None)
    found = {r.name: r.quantiles for r in preprocess.column_quantiles(df, ["x", "y"], (0.0, 0.01, 0.5, 1.0)).collect()}
    for name, own in (("x", x), ("y", np.abs(x))):
        np.testing.assert_allclose(found[name], np.quantile(own, [0.0, 0.01, 0.5, 1.0]), atol=1e-12)


def test_rank_correlation_with_and_without_nulls(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.integers(0, 9)), float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 4)), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double")
    found = {r.name: (r.ic, r.n) for r in validation.rank_ic(df, ["a", "b", "c"]).collect()}
    table = pd.DataFrame(rows, columns=["label", "a", "b", "c"])
    for name in "ab":
        own = table[["label", name]].dropna().rank()
        assert found[name] == (pytest.approx(own.corr().iloc[0, 1], abs=1e-12), len(own))
    assert found["c"] == (0.0, 300)
    assert plan(validation.rank_ic(df, ["a"])).count("SortMergeJoin") == 0


def test_words_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "good very good"), (2, "bad")], "doc_id int, text string")
    words = sentiment.weighted_words(df, "doc_id", sentiment.tokens(df["text"]))
    assert plan(words).count("Exchange") == 1


def test_lines_are_dealt_before_they_are_summed(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 10)
    tasks = session.tasks_of(views.table(spark, sf_dir, "lineitem"))
    above, _, below = plan(views.bars(spark, sf_dir)).partition("REPARTITION_BY_NUM")
    assert f", {tasks})" in above.rsplit("Exchange hashpartitioning(l_suppkey", 1)[1] and tasks > 4
    assert "Aggregate" in above and "Aggregate" not in below
    assert above.count("Exchange hashpartitioning(l_suppkey") == 1
