"""Every query against its oracle at the smallest size, and the fixtures of the operators."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    show = lambda v: "-" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(pdf.columns), sorted(tuple(show(v) for v in r) for r in pdf.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    kinds = {c: t for c, t in got.dtypes}
    for f in want.schema:
        if str(f.type) in ("int64", "int32", "double", "string", "bool"):
            assert kinds[f.name] == {"int64": "bigint", "int32": "int", "double": "double", "string": "string", "bool": "boolean"}[str(f.type)], f.name
    assert rows(got.toPandas()) == rows(want.to_pandas())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
