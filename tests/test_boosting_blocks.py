"""The booster's blocks against the operators on tables, and queries that fit with all of their rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting, validation
from quantloom.operators.boosting import Settings
from quantloom.plans import fitting, queries
from test_boosting import panel


def arrays(rows):
    """Columns of collected rows by date and symbol, and the first rows of the dates."""
    held = sorted(rows, key=lambda r: (r.date, r.symbol))
    of = {c: np.array([r[c] for r in held]) for c in held[0].asDict() if c != "bins"}
    return of, np.unique(of["date"], return_index=True)[1]


@pytest.mark.parametrize("top", [1, 5, 100])
def test_blocks_have_the_gradients_and_ndcg_of_tables(spark, monkeypatch, top):
    monkeypatch.setattr(boosting, "PAIRED", 7)
    rows = boosting.graded(panel(spark, 6, 20).where("date != 3 OR symbol = 's001'").withColumn("score", F.round(F.col("x"), 0)), top=top)
    of, starts = arrays(boosting.rank_gradients(rows, top).collect())
    np.testing.assert_allclose(boosting.block_gradients(of["score"], of["rel"], of["ideal"][starts], starts, top), [of["g"], of["h"]], atol=1e-12)
    want = {r.date: r.ndcg for r in validation.ndcg(rows.withColumn("pred_ret", F.col("score")), top).collect()}
    np.testing.assert_allclose(boosting.block_ndcg(of["score"], of["rel"], starts, top), [want[d] for d in sorted(want)], atol=1e-12)


@pytest.mark.parametrize("s", [Settings(), Settings(objective="squared"), Settings(objective="squared", judge="ndcg")])
def test_tasks_and_batches_do_not_change_the_trees(spark, monkeypatch, s):
    rows, names = panel(spark, 20, 25), ["x", "y", "z"]
    train, val = rows.where("date < 15"), rows.where("date >= 15")
    fit = lambda: boosting.boost(train, val, names, s, rounds=11, patience=11, depth=3, rate=0.3, least_rows=5)
    want = fit()
    original, before = boosting.dealt, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(boosting, "dealt", lambda df, *keys: original(df, *keys, tasks=5))
    monkeypatch.setattr(boosting, "FEW", 2)
    monkeypatch.setattr(boosting, "PAIRED", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    found = fit()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found.history == pytest.approx(want.history) and len(found.history) == 11
    assert [t.splits for t in found.trees] == [t.splits for t in want.trees] and found.trees
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_trees_on_arrays_come_to_the_nodes_of_tables(spark):
    tree = boosting.Tree({1: (0, 3), 3: (1, 0), 6: (0, 5)}, {1: 9.0, 2: 1.0, 3: 9.0, 6: 9.0, 7: 2.0, 12: 3.0, 13: 4.0})
    bins = [[a, b] for a in range(8) for b in range(2)]
    rows = spark.createDataFrame([(x,) for x in bins], "bins array<int>").select("bins", tree.node().alias("node"), tree.leaf_value().alias("value"))
    want = {tuple(r.bins): (r.node, r.value) for r in rows.collect()}
    nodes, values = tree.reached(np.array(bins)), tree.predict(np.array(bins))
    assert [(n, v) for n, v in zip(nodes.tolist(), values.tolist(), strict=True)] == [want[tuple(x)] for x in bins]
    assert boosting.Tree().reached(np.array(bins)).tolist() == [1] * 16 and boosting.Tree(values={1: 5.0}).predict(np.array(bins)).tolist() == [5.0] * 16


def kept(monkeypatch):
    """What the boosters that a query fits come out as."""
    out, original = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda *a, **k: out.append(original(*a, **k)) or out[-1])
    return out


def whole(found):
    return len(found.history) == found.settings.rounds == 1000 or (len(found.history) - len(found.trees) == found.settings.patience == 50)


def test_rank_boost_has_all_of_the_settings_rounds(spark, sf_dir, monkeypatch):
    fitted = kept(monkeypatch)
    assert fitting.queries()["rank_boost"](spark, sf_dir).count() > 0
    assert [x.settings for x in fitted] == [Settings()] and whole(fitted[0])


def test_gbt_rank_has_all_of_the_settings_rounds(spark, sf_dir, monkeypatch):
    fitted = kept(monkeypatch)
    assert queries.queries()["gbt_rank"](spark, sf_dir).count() > 0
    assert [x.settings for x in fitted] == [Settings(objective="squared", judge="ndcg")] and whole(fitted[0])


def test_a_target_other_than_the_label_judged_by_ndcg(spark):
    rows = panel(spark, 16, 25).withColumn("target", -F.col("x")).withColumn("label", F.col("z"))
    fitted = boosting.boost(rows.where("date < 12"), rows.where("date >= 12"), ["x", "y", "z"], Settings(objective="squared", judge="ndcg", rounds=6, depth=3, rate=0.3, least_rows=5, feature_share=1), label="target")
    predicted = fitted.predict(rows.where("date >= 12"))
    mine = validation.ndcg(predicted.withColumn("label", F.col("target")), 10).agg(F.avg("ndcg")).first()[0]
    assert fitted.importance()[0][0] == "x" and mine == pytest.approx(max(fitted.history)) and mine > 0.8
