"""Factors against pandas on literal series, and properties that all factors share."""

import datetime

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import expr
from quantloom.operators import factors, models, preprocess, selection, validation
from quantloom.plans import queries

SCHEMA = "market string, symbol string, name string, industry string, date date, open double, high double, low double, close double, volume double, amount double, turnover double"


def bars(spark, closes, symbol="A", volumes=None):
    rows = []
    for i, c in enumerate(closes):
        day = datetime.date(2020, 1, 6) + datetime.timedelta(days=7 * i)
        v = volumes[i] if volumes is not None else 100.0 + (i * 37) % 50
        rows.append(("US", symbol, symbol, "x", day, c * 0.99, c * 1.02, c * 0.97, c, float(v), c * v, 0.1))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(0)
    return (100 * np.exp(np.cumsum(rng.normal(0, 0.05, 80)))).tolist()


def ordered(df):
    return df.orderBy("symbol", "date").toPandas()


def test_against_pandas(spark, walk):
    out = ordered(factors.rsi(factors.macd(factors.quantile(factors.volatility(factors.ma(bars(spark, walk)))))))
    c = pd.Series(walk)
    np.testing.assert_allclose(out["ma_10"], c.rolling(10, min_periods=5).mean().fillna(0), rtol=1e-12)
    ret = ((c - c.shift()) / c).fillna(0)
    np.testing.assert_allclose(out["volatility_5"], ret.rolling(5, min_periods=2).std(ddof=0).fillna(0), atol=1e-14)
    np.testing.assert_allclose(out["QTLU_20"], c.rolling(20, min_periods=10).quantile(0.8).fillna(c[0]) / c, rtol=1e-12)
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    np.testing.assert_allclose(out["macd"], ema(c, 12) - ema(c, 26), atol=1e-10)
    d = c.diff()
    g, l = ema(d.clip(lower=0)[1:], 14), ema((-d).clip(lower=0)[1:], 14)  # noqa: E741
    np.testing.assert_allclose(out["rsi_14"][1:], 100 - 100 / (1 + g / np.maximum(l, 1e-10)), rtol=1e-9)
    assert out["rsi_14"][0] == 50


def test_exponential_means_over_many_blocks_and_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 700) + 50
    x[[0, 1, 63, 64, 65, 300]] = np.nan
    rows = [("B", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    out = expr.with_emas(df, {"fast": ("x", 3), "slow": ("x", 60)}).orderBy("date").toPandas()
    for name, span in (("fast", 3), ("slow", 60)):
        want, now = [], None
        for v in x:
            now = now if np.isnan(v) else v if now is None else now + (v - now) * 2 / (span + 1)
            want.append(np.nan if now is None else now)
        np.testing.assert_allclose(out[name].astype(float), want, rtol=1e-12)
    assert out.columns.tolist() == ["symbol", "date", "x", "fast", "slow"]


def test_quantiles_of_whole_columns_are_exact(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 501).astype(float), rng.normal(size=501)
    df = spark.createDataFrame([(float(x), None if i % 9 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double").repartition(5)
    found = {r.name: r.quantiles for r in preprocess.column_quantiles(df, ["a", "b"], (0.01, 0.5, 0.99)).collect()}
    np.testing.assert_allclose(found["a"], np.quantile(a, [0.01, 0.5, 0.99]), rtol=1e-12)
    np.testing.assert_allclose(found["b"], np.quantile([y for i, y in enumerate(b) if i % 9], [0.01, 0.5, 0.99]), rtol=1e-12)
    same = preprocess.winsorize(df.where("false"), ["a", "b"])
    assert same.columns == ["a", "b"] and same.count() == 0


def test_flat_series_and_zero_volume_are_guarded(spark):
    out = ordered(factors.panel(bars(spark, [5.0] * 70, volumes=[0.0] * 70)).drop("market", "name", "industry"))
    numbers = out.drop(columns=["symbol", "date"])
    assert np.isfinite(numbers.to_numpy(dtype=float)).all()
    assert (out["RSQR_5"] == 0).all() and (out["bb_position"] == 0).all() and (out["CORR_10"] == 0).all() and (out["cci_20"] == 0).all()


def test_short_series(spark):
    for n in (1, 2):
        out = ordered(factors.label(factors.panel(bars(spark, [3.0, 4.0][:n]))))
        assert pd.isna(out["label"].iloc[-1])
        assert out["BETA_5"].tolist() == [0.0] * n


def test_ramp_has_slope_one_and_no_residual(spark):
    out = ordered(factors.aroon(factors.regression(bars(spark, [float(i + 1) for i in range(80)]))))
    np.testing.assert_allclose(out["BETA_20"][19:] * out["close"][19:], 1.0)
    np.testing.assert_allclose(out["RSQR_20"][19:], 1.0)
    np.testing.assert_allclose(out["RESI_20"][19:], 0.0, atol=1e-12)
    assert out["IMAX_10"][20] == 0.9 and out["IMIN_10"][20] == 0.0


def test_causal_and_separate(spark, walk):
    names = ("ma", "macd", "cci", "rank", "aroon", "corr", "cord", "sum", "wvma", "quantile")
    both = bars(spark, walk).unionByName(bars(spark, walk[::-1], "B"))
    whole = ordered(factors.panel(both, names).where("symbol = 'A'"))
    cut = ordered(factors.panel(bars(spark, walk[:50]), names))
    columns = [c for c in cut.columns if cut[c].dtype == float]
    np.testing.assert_allclose(whole[columns][:50], cut[columns], atol=1e-12)


def test_ranks_with_ties(spark):
    rows = [("m", s, datetime.date(2020, 1, 1), x, x) for s, x in zip("abcd", (2.0, 2.0, 1.0, 3.0), strict=True)]
    df = spark.createDataFrame(rows, "market string, symbol string, date date, x double, y double")
    out = preprocess.cross_sectional_rank(df, ["x", "y"]).orderBy("symbol").toPandas()
    assert out["x"].tolist() == [0.625, 0.625, 0.25, 1.0]


def test_quantile_groups_match_qcut(spark):
    for n in (10, 13, 24, 57):
        rows = [(datetime.date(2020, 1, 1), f"{i:03}", float((i * 31) % 17), 0.0) for i in range(n)]
        df = spark.createDataFrame(rows, "date date, symbol string, pred_ret double, label double")
        got = selection.quantile_groups(df).orderBy("pred_ret", "date", "symbol").toPandas()["grp"].tolist()
        want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[f"Q{i}" for i in range(1, 6)]).tolist()
        assert got == want


def test_filters_use_the_whole_history(spark, walk):
    df = factors.pct_change(factors.volume(bars(spark, walk)))
    rules = spark.createDataFrame([("US", None, 0.0, False)], "market string, price_limit double, min_amount double, st_filter boolean")
    assert selection.filter_market(df, rules, 60).count() == 1
    assert selection.filter_market(df, rules, 81).count() == 0


def test_folds_keep_the_embargo(spark, walk):
    dates = {r.fold: r for r in validation.cv_folds(bars(spark, walk), least_train=1, least_val=1).collect()}
    assert sorted(dates) == [1, 2, 3]
    assert all((r.val_first - r.train_last).days == 7 * 6 for r in dates.values())


def test_training_picks_a_fold_and_stacks(spark, sf_dir):
    panel = queries._labelled(spark, sf_dir).select("market", "symbol", "date", "label", *queries.FEATURES)
    got = models.train(panel, queries.FEATURES, least=2, threshold=1.0, maxIter=2, maxDepth=2)
    assert len(got.features) == 2 and got.fold in (1, 2, 3) and 0 < got.ndcg <= 1 and all(map(np.isfinite, got.weights))
    out = got.predict(panel)
    assert out.columns == [*panel.columns, "pred_ret"] and out.count() == panel.count()
    assert models.train(panel, queries.FEATURES, least_rows=10**6) is None
    ((value, params),) = models.search([(panel, panel)], queries.FEATURES[:1], trials=1)
    assert 0 < value <= 1 and set(params) == {"maxDepth", "stepSize", "subsamplingRate", "maxIter"}


def test_walk_forward_models_see_only_the_past(spark, sf_dir):
    panel = queries._labelled(spark, sf_dir).select("market", "symbol", "date", "label", *queries.FEATURES)
    n = panel.where("label IS NOT NULL").select("date").distinct().count()
    out = models.walk_forward_fit(panel, queries.FEATURES, n - 8, 5, maxIter=1, maxDepth=2)
    assert {r.start for r in out.select("start").distinct().collect()} == {0, 5}
    assert out.groupBy("symbol", "date").count().where("count > 1").isEmpty()
    assert out.select("date").distinct().count() == 8
    assert models.walk_forward_fit(panel, queries.FEATURES, n - 8, 5, least_rows=10**6) is None
