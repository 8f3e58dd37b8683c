"""Every query against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pandas as pd
import pytest

import __spark_entry__ as contract
from small_data import SMALL
from fieldloom.plans.catalog import QUERIES
from fieldloom.plans.oracle import ORACLE

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def plain(value):
    if value is None or value is pd.NaT:
        return None
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else value


def ordered(rows):
    return sorted([tuple(plain(v) for v in row) for row in rows],
                  key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_without_the_training_data_queries():
    # as when the subpackage and the pipeline file are deleted
    code = ("import sys; sys.modules['fieldloom.llm'] = None; import __spark_entry__ as e; "
            "assert not any(n.startswith('op1_') for n in e.queries()) and len(e.queries()) > 70")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    assert contract.entry(spark).count() == 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    expected = ordered([[row[names.index(c)] for c in columns] for row in result.fetchall()])
    assert ordered(df.select(*columns).collect()) == expected
