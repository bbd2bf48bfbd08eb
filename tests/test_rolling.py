"""Rolling moments over Arrow batches against pandas, and tasks that grow in number with the input."""

import datetime
import re

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import rolling, session
from quantloom.operators import factors
from quantloom.plans import queries


@pytest.fixture
def short_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def series(spark, lengths=(1, 3, 40, 75)):
    rng, rows = np.random.default_rng(3), []
    for s, n in enumerate(lengths):
        for i in range(n):
            hole = s == 2 and i in (4, 5, 20)
            rows.append(("US", f"s{s}", datetime.date(2020, 1, 6) + datetime.timedelta(days=7 * i), None if hole else float(rng.normal(1e6, 2)), float(rng.integers(1, 50)) if s != 1 else 7.0))
    return spark.createDataFrame(rows, "market string, symbol string, date date, close double, volume double")


def test_moments_equal_pandas_over_short_batches(spark, short_batches):
    out = factors.corr(factors.regression(series(spark))).orderBy("symbol", "date").toPandas()
    for _, own in out.groupby("symbol"):
        x, y = own["close"].reset_index(drop=True), np.log(own["volume"].reset_index(drop=True) + 1)
        y[x.isna()] = np.nan
        for w in (5, 20, 60):
            want = x.rolling(w).apply(lambda v: np.polyfit(np.arange(len(v)), v - v.mean(), 1)[0], raw=True) / x  # noqa: B023
            np.testing.assert_allclose(own[f"BETA_{w}"], want.fillna(0), rtol=1e-7, atol=1e-13)
            fit = x.rolling(w).apply(lambda v: np.corrcoef(np.arange(len(v)), v)[0, 1] ** 2, raw=True)
            np.testing.assert_allclose(own[f"RSQR_{w}"], fit.fillna(0), rtol=1e-6, atol=1e-12)
            pairs = [pd.concat([x, y], axis=1).iloc[max(0, i - w + 1) : i + 1].dropna() for i in range(len(x))]
            both = [np.corrcoef(p.to_numpy().T)[0, 1] if len(p) >= max(2, w // 2) and p.iloc[:, 1].std() > 0 else 0.0 for p in pairs]
            np.testing.assert_allclose(own[f"CORR_{w}"], both, rtol=1e-6, atol=1e-9)


def test_moments_take_no_spark_window(spark, sf_dir):
    for name in ("f_beta", "f_rsqr", "f_corr", "f_cord"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "regr_slope" not in plan and "covar_pop" not in plan and "MapInArrow" in plan


def test_tasks_grow_with_the_input(spark, sf_dir, monkeypatch):
    bars = queries.views.bars(spark, sf_dir)
    assert session.tasks_of(bars) is None
    monkeypatch.setattr(session, "BYTES_A_TASK", 10_000)
    many = session.tasks_of(bars)
    assert many > 10
    assert factors.family(bars, "rsi").rdd.getNumPartitions() == many
    assert factors.family(bars, "cord").rdd.getNumPartitions() == many


@pytest.mark.parametrize("name", ["macd", "rsi"])
def test_tasks_grow_below_the_shuffle_partitions(spark, sf_dir, monkeypatch, name):
    bars = queries.views.bars(spark, sf_dir)
    monkeypatch.setattr(session, "BYTES_A_TASK", 10_000)
    many = session.tasks_of(bars)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * many))  # as the default is: AQE would leave one a core
    found = factors.family(bars, name).rdd.getNumPartitions()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == many > 4


@pytest.mark.parametrize("name", ["src_bars", "label_t1", "ts_zscore", "ffill", "filter_liquidity", "s_rolling"])
def test_windows_over_bars_deal_them(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(session, "BYTES_A_TASK", 10_000)
    many = session.tasks_of(queries.views.bars(spark, sf_dir))
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(symbol#\d+, {many}\), REPARTITION_BY_NUM", plan)
