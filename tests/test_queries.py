"""Every query against its SQL in DuckDB on the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quantloom.operators import validation
from quantloom.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.6g}"
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def test_every_query_but_the_model_has_sql():
    assert set(queries.queries()) - set(ORACLE) == {"gbt_rank", "model_round_trip", "ic_p_values", "rank_boost"}
    assert set(ORACLE) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = rows(queries.queries()[name](spark, sf_dir).toPandas()), rows(duck.execute(ORACLE[name]).fetch_df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_models_and_tails(spark, sf_dir):
    found = {r.feature: r.importance for r in queries.queries()["model_round_trip"](spark, sf_dir).collect()}
    assert set(found) == set(queries.FEATURES) and sum(found.values()) == pytest.approx(1)
    for r in queries.queries()["ic_p_values"](spark, sf_dir).collect():
        assert 0 <= r.p_value <= 1 and (r.p_value < 0.05) == (abs(r.t_stat) > 1.9604 if r.n > 10_000 else abs(r.t_stat) > 1.962)


@pytest.mark.parametrize(("t", "freedom", "p"), [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 10, 0.0733880), (-2.0, 10, 0.0733880), (12.706205, 1, 0.05), (1.959964, 1e9, 0.05), (4.0, 30, 0.000380), (None, 5, None), (1.0, 0, None)])
def test_tails_of_t(t, freedom, p):
    assert validation.p_value(t, freedom) == (p if p is None else pytest.approx(p, abs=2e-6))


def test_entry_and_gbt(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["date", "ret", "cum"]
    ranked = queries.queries()["gbt_rank"](spark, sf_dir)
    assert {"date", "ndcg"} == set(ranked.columns)
    found = [r.ndcg for r in ranked.collect()]
    assert found and all(0 <= x <= 1 for x in found) and len(set(found)) > 1
