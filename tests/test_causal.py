"""Bounds without the future: their error, their prefixes and the cases that are defined."""

import datetime as dt
import math

import numpy as np
import pytest

from quantloom.operators import causal

DAY = dt.date(2020, 1, 1)


def make(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(days=d) if d is not None else None, s, x, y, 7) for d, s, x, y in rows], "date date, symbol string, x double, y double, _day int")


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    days = rng.integers(0, 40, 1500)
    x = rng.normal(size=1500) * 10.0 ** rng.integers(-6, 6, 1500)
    return [(int(d), f"s{i}", float(v), None if i % 7 == 0 else float(round(v, 1))) for i, (d, v) in enumerate(zip(days, x, strict=True))]


@pytest.mark.parametrize("block_days", [366, 5])
def test_bounds_are_within_the_error_of_the_exact_ones(spark, panel, block_days):
    found = {(r.column, r.day): (r.low, r.high) for r in causal.bounds_to_date(make(spark, panel), ["x", "y"], 0.05, 0.95, 0.01, block_days).collect()}
    for column in (0, 1):
        for day in sorted({r[0] for r in panel}):
            past = sorted(r[2 + column] for r in panel if r[0] <= day and r[2 + column] is not None)
            for got, share in zip(found[column, (DAY - dt.date(1970, 1, 1)).days + day], (0.05, 0.95), strict=True):
                want = past[math.floor(share * (len(past) - 1))]
                assert abs(got - want) <= 0.01 * abs(want) * (1 + 1e-9) + 1e-12


def test_later_rows_change_nothing_and_blocks_agree(spark, panel):
    def clipped(rows, **how):
        return sorted(map(tuple, causal.winsorize_to_date(make(spark, rows), ["x", "y"], 0.1, 0.9, **how).collect()), key=str)

    early = clipped([r for r in panel if r[0] <= 20])
    every = clipped(panel)
    assert early == [r for r in every if r[0] <= DAY + dt.timedelta(days=20)]
    assert every == clipped(panel, block_days=3)
    assert any(r not in every for r in map(tuple, make(spark, panel).collect()))


def test_defined_cases(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, "a", 1.0, None), (0, "b", 1.0, None), (0, "c", inf, None), (0, "d", -inf, 2.0), (0, "e", nan, -3.0), (0, "f", None, 0.0), (None, "g", 1e9, 5.0), (1, "h", inf, None), (2, "i", 50.0, 4.0)]
    df = make(spark, rows)
    out = causal.winsorize_to_date(df, ["x", "y"], 0.01, 0.99)
    assert out.columns == df.columns
    found = {r.symbol: (r.x, r.y) for r in out.collect()}
    assert len(found) == len(rows)
    assert found["a"][1] is None and found["f"][0] is None and math.isnan(found["e"][0])
    for symbol in ("a", "b", "c", "d"):
        assert found[symbol][0] == pytest.approx(1.0, rel=0.003)
    assert found["g"] == (1e9, 5.0) and found["h"] == (inf, None)
    assert found["i"][0] == pytest.approx(1.0, rel=0.003)  # two ones and 50: the lower quantile is 1
    assert found["f"][1] == pytest.approx(0.0, abs=1e-12)
    assert causal.winsorize_to_date(df.where("false"), ["x"]).collect() == []
    assert causal.winsorize_to_date(df, ["x"], 0.0, 1.0) is df
