"""Every plan of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from trailmark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def normal(v):
    if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) == "NaT":
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(normal, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_plan_equals_sql(spark, duck, name):
    got = rows(registry.queries()[name](spark, DIR).toPandas())
    want = rows(duck.execute(registry.oracle_sql()[name]).df())

    def plain(side):  # whole numbers look alike whatever their type
        return side[0], sorted(tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in side[1])

    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_plan_without_sql_runs(spark, name):
    found = registry.queries()[name](spark, DIR)
    first, again = (sorted(map(str, found.collect())) for _ in range(2))
    assert first and first == again and len(set(found.columns)) == len(found.columns)
