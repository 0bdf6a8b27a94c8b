from __future__ import annotations

import os
import subprocess
import sys

import pytest

from docweave import registry
from tests.sql import connection, same

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def test_entry_without_the_training_data_part(tmp_path):
    """The driver's module imports, and keeps the other queries, where those folders are gone."""
    for name in ("__spark_entry__.py", "docweave"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "docweave" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))], said.stderr
