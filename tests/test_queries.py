"""Every core query against its SQL on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from quire import registry
from tests.conftest import DATA


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: "null" if pd.api.types.is_scalar(x) and pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)
    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() > 0


def test_native_plans_have_no_python(spark, data):
    for name in ("bm25_topk", "section_hits", "section_path", "history_window", "source_completion"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
