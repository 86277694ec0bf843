"""Every registered query: its plan, and its result against its SQL counterpart in DuckDB."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_file
from pillflow.testbed.mapping import BASE_TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_no_python_in_plans():
    """Rounds cut their plans by checkpoints, so what ran before cannot be seen in the last plan: look at the sources."""
    for source in (Path(entry_file.__file__).parent / "pillflow").rglob("*.py"):
        if source.parent.name != "llm":
            assert not re.search(r"mapInPandas|applyInPandas|mapInArrow|\budf\b|pandas_udf|toPandas|\.rdd\b|localCheckpoint|tempfile", source.read_text(encoding="utf-8")), source


def check_plan(df):
    """No Python, no cross join; a window over everything only on one row per slice."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", text)
    for gathered in re.finditer(r"Window \[[^\n]*\n[^\n]*Sort \[(\w+)#[^\n]*\n[^\n]*Exchange SinglePartition", text):
        assert gathered.group(1) == "_slice"


OWN = {*entry_file.READS, *entry_file.BATCHES}


@pytest.mark.parametrize("name", sorted(OWN))
def test_same_result(spark, duck, name):
    df = entry_file.queries()[name](spark, SMALL)
    check_plan(df)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in entry_file.oracle_sql():
        assert found
        return
    result = duck.execute(entry_file.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0
