"""The operators' SQL against the operators."""

import duckdb
import pytest

from millrace.llm.oracle import ORACLES
from millrace.llm.queries import QUERIES
from tests.test_catalogue import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(ORACLES[name]).to_arrow_table().to_pandas()
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(want)
