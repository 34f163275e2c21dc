"""Every registered query of the subpackage on the smallest tables, against its SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as driver
from profilar.llm import catalogue
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, docs, name):
    assert name in driver.queries()
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in catalogue.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        verdict = compare(got, con.execute(catalogue.SQL[name]).df())
        assert verdict.startswith("ok"), verdict


def test_one_query_per_operator():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in catalogue.QUERIES) == 1
    assert "pipeline" in driver.queries()
