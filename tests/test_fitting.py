"""Sliding fits and parameter search against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting, search, validation


def rows_of(seed=4, dates=60, symbols=12):
    rng = random.Random(seed)
    out = []
    for d in range(dates):
        for i in range(symbols if d != 7 else 1):
            x, y, z = (1000 + rng.gauss(0, 1) for _ in range(3))
            label = 0.3 * x - 2 * y + (d % 5) * 0.1 * z + rng.gauss(0, 0.1)
            out.append((d, f"s{i}", x, y if rng.random() > 0.1 else None, z if rng.random() > 0.1 else float("nan"), label if rng.random() > 0.1 else None))
    return out


def brute(rows, train, step):
    dates = sorted({r[0] for r in rows})
    found = {}
    for start in range(0, len(dates) - train, step):
        past, coming = set(dates[start : start + train]), set(dates[start + train : start + train + step])
        good = np.array([r[2:] for r in rows if r[0] in past and all(v is not None and math.isfinite(v) for v in r[2:])])
        m = good.mean(0)
        slopes = np.linalg.lstsq(good[:, :3] - m[:3], good[:, 3] - m[3], rcond=None)[0]
        for r in rows:
            if r[0] in coming and all(v is not None and math.isfinite(v) for v in r[2:5]):
                found[r[0], r[1]] = (start, float(m[3] + slopes @ (np.array(r[2:5]) - m[:3])))
    return found


@pytest.mark.parametrize(("train", "step"), [(20, 5), (7, 3), (59, 1)])
def test_sliding_fits_equal_fitting_every_window(spark, train, step):
    rows = rows_of()
    table = spark.createDataFrame(rows, "day int, symbol string, x double, y double, z double, label double").withColumn("date", F.date_from_unix_date("day"))
    found = validation.walk_forward_normal(table, ["x", "y", "z"], "label", train, step)
    got = {(r.day, r.symbol): (r.start, r.pred_ret) for r in found.collect() if r.pred_ret is not None and math.isfinite(r.pred_ret)}
    want = brute(rows, train, step)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_a_window_costs_dates_and_not_rows(spark):
    one, many = (spark.createDataFrame([(1, [1.0] * 9)] * n, "day int, sums array<double>") for n in (1, 40))
    assert [x.rdd.getNumPartitions() for x in (validation.sliding_fits(t, 1, 5, 1, 0.0) for t in (one, many))] == [1, 1]
    rows = spark.range(10_000).select((F.col("id") % 7).cast("int").alias("d"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    sums = rows.withColumn("d", F.date_from_unix_date("d")).mapInArrow(validation._products, "day int, sums array<double>").groupBy("day").applyInArrow(validation._added, "day int, sums array<double>").collect()
    assert len(sums) == 7 and sum(r.sums[0] for r in sums) == 10_000


def test_too_few_dates_and_constant_features(spark):
    table = spark.createDataFrame([(d, "a", 1.0, float(d)) for d in range(6)], "day int, symbol string, x double, label double").withColumn("date", F.date_from_unix_date("day"))
    assert validation.walk_forward_normal(table, ["x"], "label", 6, 1).count() == 0
    assert [r.pred_ret for r in validation.walk_forward_normal(table, ["x"], "label", 3, 1).orderBy("day").collect()] == pytest.approx([1.0, 2.0, 3.0])


# ------------------------------------------------------------------ search


def test_density_is_one_and_equals_its_definition():
    points = [0.0, 0.2, 0.95]
    grid = np.linspace(0, 1, 20_001)
    values = [search.density(x, points) for x in grid]
    assert np.trapezoid(values, grid) == pytest.approx(1, abs=1e-6)
    width = 0.25
    kernel = lambda x, p: math.exp(-((x - p) ** 2) / 2 / width**2)
    for x in (0.0, 0.3, 1.0):
        want = (1 + sum(kernel(x, p) / np.trapezoid([kernel(g, p) for g in grid], grid) for p in points)) / 4
        assert search.density(x, points) == pytest.approx(want, rel=1e-6)


def test_draws_follow_the_density():
    rng, points = random.Random(1), [0.1, 0.15, 0.9]
    drawn = np.histogram([search.draw(points, rng) for _ in range(40_000)], bins=10, range=(0, 1))[0] / 40_000
    grid = np.linspace(0, 1, 1001)
    want = [np.trapezoid([search.density(x, points) for x in grid[i * 100 : i * 100 + 101]], grid[i * 100 : i * 100 + 101]) for i in range(10)]
    assert np.abs(drawn - want).max() < 0.02


def test_a_suggestion_has_the_greatest_ratio_of_its_draws(monkeypatch):
    rng = random.Random(5)
    history = [search.Trial({"a": rng.random()}, {}, [0.0]) for _ in range(12)]
    for t in history:
        t.values[0] = -abs(t.places["a"] - 0.7)
    good = sorted(history, key=lambda t: -t.values[0])[:3]
    bad = [t.places["a"] for t in history if t not in good]
    seen = []
    original = search.draw
    monkeypatch.setattr(search, "draw", lambda p, r: seen.append(original(p, r)) or seen[-1])
    found = search.suggest(history, {"a": (0, 1, "float")}, random.Random(3))["a"]
    ratio = lambda x: search.density(x, [t.places["a"] for t in good]) / search.density(x, bad)
    assert len(seen) == search.DRAWS and found == max(seen, key=ratio)


def test_ranges_and_kinds():
    rng = random.Random(2)
    for name, (low, high, kind) in search.SPACE.items():
        values = [search.value_at(rng.random(), low, high, kind) for _ in range(2000)] + [search.value_at(x, low, high, kind) for x in (0, 1)]
        assert min(values) >= low and max(values) <= high, name
        assert (min(values), max(values)) == (low, high) if kind == "int" else True
    assert search.value_at(0.5, 1e-8, 10.0, "log") == pytest.approx(math.sqrt(1e-7))
    assert len(search.SPACE) == 10


def test_search_finds_drops_and_repeats():
    asked = []

    def objective(params, rung):
        asked.append(rung)
        return -((math.log10(params["a"]) + 3) ** 2) - (params["b"] - 7) ** 2 / 10 + rung * 0.01

    space = {"a": (1e-8, 10.0, "log"), "b": (1, 10, "int")}
    found = search.search(objective, 3, 60, space, seed=9)
    assert found[0].values[-1] > -0.5 and len(found[0].values) == 3 and len(found) == 60
    cost = {0: 1, 1: 10, 2: 100}
    assert sum(cost[r] for r in asked) < 0.6 * 60 * sum(cost.values())
    first = [t.params for t in found]
    assert [t.params for t in search.search(objective, 3, 60, space, seed=9)] == first
    blind = random.Random(9)
    alone = max(objective({n: search.value_at(blind.random(), *space[n]) for n in space}, 2) for _ in range(60))
    assert found[0].values[-1] >= alone - 0.3


def test_tuning_reads_fewer_rounds_than_full_trials(spark, monkeypatch):
    rng = random.Random(1)
    rows = spark.createDataFrame([(d, f"s{i}", rng.gauss(0, 1), float(rng.random())) for d in range(8) for i in range(12)], "date int, symbol string, x double, label double")
    pair = (rows.where("date < 6"), rows.where("date >= 6"))
    used = []
    original = boosting.boost
    monkeypatch.setattr(search, "boost", lambda *a, **k: used.append(a[3].rounds) or original(*a, **k))
    found = search.tune([pair], ["x"], trials=3, rounds=(1, 2))
    assert len(found) == 3 and set(found[0].params) == set(search.SPACE) and sum(used) < 3 * 3
