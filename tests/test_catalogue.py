"""Every registered query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from maskwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in cursor.fetchall()), key=str)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(map(same, x, y)), (x, y)


def test_dictionary_plan_has_no_cross_join(spark):
    plan = catalogue.QUERIES["dictionary_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_what_they_need(spark):
    plan = catalogue.QUERIES["recall_by_lang"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1][:200] and plan.count("Exchange") == 1
