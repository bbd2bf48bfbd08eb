"""Boosting: gradients and splits against brute force, early stopping, ranking against pointwise trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting, models
from quantloom.operators.boosting import Settings

SCHEMA = "date int, symbol string, x double, y double, z double, label double"


def panel(spark, dates=30, symbols=25, seed=2, noise=0.5):
    rng = random.Random(seed)
    rows = []
    for d in range(dates):
        for i in range(symbols):
            x, y, z = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((d, f"s{i:03}", x, y if rng.random() > 0.05 else None, z, (x > 0.3) * 2 + (y or 0) * 0.5 + rng.gauss(0, noise)))
    return spark.createDataFrame(rows, SCHEMA)


def brute_gradients(rows, top):
    out = {}
    by_date = {}
    for r in rows:
        by_date.setdefault(r["date"], []).append(r)
    for held in by_date.values():
        held = sorted(held, key=lambda r: (-r["score"], r["symbol"]))
        for r in held:
            out[r["date"], r["symbol"]] = [0.0, 0.0]
        ideal = sum((2 ** r - 1) / math.log2(i + 2) for i, r in enumerate(sorted((r["rel"] for r in held), reverse=True)[:top]))
        for i, a in enumerate(held):
            for j in range(i + 1, len(held)):
                b = held[j]
                if a["rel"] == b["rel"] or i >= top:
                    continue
                good, bad = (a, b) if a["rel"] > b["rel"] else (b, a)
                weight = abs(2 ** a["rel"] - 2 ** b["rel"]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / ideal
                chance = 1 / (1 + math.exp(good["score"] - bad["score"]))
                out[good["date"], good["symbol"]][0] -= weight * chance
                out[bad["date"], bad["symbol"]][0] += weight * chance
                for r in (good, bad):
                    out[r["date"], r["symbol"]][1] += weight * chance * (1 - chance)
    return out


@pytest.mark.parametrize("top", [1, 5, 100])
def test_gradients_equal_all_pairs(spark, top):
    rows = boosting.graded(panel(spark, 6, 20).withColumn("score", F.round(F.col("x"), 0)), top=top)
    want = brute_gradients(rows.collect(), top)
    found = {(r.date, r.symbol): [r.g, r.h] for r in boosting.rank_gradients(rows, top).collect()}
    assert set(found) == set(want)
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_one_grade_has_no_gradient(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (1, "b", 1.0, 0.0, 0.0)], "date int, symbol string, score double, rel double, ideal double")
    assert [(r.g, r.h) for r in boosting.rank_gradients(rows).collect()] == [(0.0, 0.0)] * 2


def test_a_stump_equals_trying_all_splits(spark):
    rows, s = panel(spark, 10, 30), Settings(objective="squared", depth=1, l1=0.7, l2=1.5, least_rows=15, least_hessian=10)
    names = ["x", "y", "z"]
    cuts = boosting.spread_cuts(rows, names)
    table = boosting.squared_gradients(boosting.binned(rows.withColumn("score", F.lit(0.5)), names, cuts))
    tree = boosting.grow(table, [0, 1, 2], s)
    held, best = table.collect(), None
    for f in range(3):
        for at in range(len(cuts[f]) + 1):
            sides = [[r for r in held if (r.bins[f] <= at) == left] for left in (True, False)]
            if min(map(len, sides)) < 15:
                continue
            sums = [(sum(r.g for r in x), float(len(x))) for x in (*sides, held)]
            strength = [max(abs(g) - 0.7, 0) ** 2 / (h + 1.5) for g, h in sums]
            gain = strength[0] + strength[1] - strength[2]
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, at, *(-math.copysign(max(abs(g) - 0.7, 0), g) / (h + 1.5) for g, h in sums[:2]))
    assert tree.splits == {1: best[1:3]} and tree.gains[1] == pytest.approx(best[0])
    assert [tree.values[2], tree.values[3]] == pytest.approx(best[3:])


def test_limits_on_leaves_depth_and_rows(spark):
    rows = panel(spark, 10, 30)
    names = ["x", "y", "z"]
    table = boosting.squared_gradients(boosting.binned(rows.withColumn("score", F.lit(0.0)), names, boosting.quantile_cuts(rows, names, 16)))
    tree = boosting.grow(table, [0, 1, 2], Settings(objective="squared", depth=4, leaves=5, least_rows=10))
    assert len(tree.splits) == 4 and max(tree.splits) < 16
    counts = {r.node: r.n for r in table.groupBy(tree.node().alias("node")).agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 5 and min(counts.values()) >= 10
    assert boosting.grow(table, [0], Settings(depth=3, least_rows=200)).splits == {}


def test_stops_when_validation_does_not_improve_and_keeps_the_best(spark):
    rows = panel(spark, 14, 20)
    train, val = rows.where("date < 10"), rows.where("date >= 10").withColumn("label", F.rand(3))
    found = boosting.boost(train, val, ["x", "y", "z"], Settings(rounds=12, patience=3, depth=2, rate=0.3, least_rows=5))
    best = max([0, *found.history])
    assert len(found.history) < 12 and len(found.history) - len(found.trees) == 3
    assert not found.trees or found.history[len(found.trees) - 1] == best
    assert Settings().patience == 50 and Settings().rounds == 1000


def test_ranks_better_than_pointwise_trees_and_predicts_what_it_judged(spark):
    rows = panel(spark, 24, 25)
    train, val = rows.where("date < 18"), rows.where("date >= 18")
    names = ["x", "y", "z"]
    found = boosting.boost(train, val, names, Settings(rounds=8, patience=8, depth=3, rate=0.3, least_rows=5, feature_share=1, row_share=1))
    again = boosting.boost(train, val, names, Settings(rounds=2, patience=8, depth=3, rate=0.3, least_rows=5, feature_share=1, row_share=1))
    assert again.history == pytest.approx(found.history[:2])
    predicted = found.predict(val)
    assert predicted.columns == [*val.columns, "pred_ret"]
    mine = models.mean_ndcg(predicted, 10)
    assert mine == pytest.approx(max(found.history))
    assert mine >= models.mean_ndcg(models.fit_predict(train, val.withColumn("y", F.coalesce("y", F.lit(0.0))), ["x", "z"], maxIter=8, maxDepth=3), 10) - 0.01
    assert found.importance()[0][0] == "x"


def test_squared_error_falls(spark):
    rows = panel(spark, 12, 25)
    found = boosting.boost(rows.where("date < 9"), rows.where("date >= 9"), ["x", "y", "z"], Settings(objective="squared", rounds=6, depth=3, rate=0.5, least_rows=5, row_share=1, feature_share=1))
    assert all(a < b for a, b in zip(found.history[:4], found.history[1:4], strict=False))
    odd = found.predict(spark.createDataFrame([(1, "a", None, float("nan"), 3.0, None)], SCHEMA)).collect()
    assert len(odd) == 1 and math.isfinite(odd[0].pred_ret)


def test_constant_features_and_no_rows(spark):
    rows = panel(spark, 4, 10).withColumns({"x": F.lit(1.0), "y": F.lit(None).cast("double"), "z": F.lit(2.0)})
    found = boosting.boost(rows, rows, ["x", "y", "z"], Settings(rounds=5, row_share=1, feature_share=1))
    assert found.trees == [] and len(found.history) == 1
    assert boosting.boost(rows.where("false"), rows.where("false"), ["x"], Settings(rounds=2)).trees == []
