"""Every registered query on the smallest tables, against its SQL in DuckDB where there is one."""

import os
import shutil
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402
from profilar.plans import catalogue  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    verdict = compare(got, con.execute(driver.oracle_sql()[name]).df())
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_query_runs(spark, name):
    """The whole result is computed: these queries have no SQL, their operators are tested elsewhere."""
    assert driver.queries()[name](spark, FOLDER).collect()


def test_entry_without_the_optional_subpackage(tmp_path):
    """A copy without the subpackage lists the other queries."""
    root = os.path.dirname(os.path.abspath(driver.__file__))
    shutil.copytree(os.path.join(root, "profilar"), tmp_path / "profilar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in out] == [len(catalogue.QUERIES), len(catalogue.SQL)]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
