"""Every registered query against its SQL, and rules on plans and sources."""

import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from workloads.harness import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, fn in entry_module.queries().items() if name in entry_module._ALL}
SQL = {name: sql for name, sql in entry_module.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    same, message = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert same, message


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = pathlib.Path(entry_module.__file__).parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', len(e.queries()['prototype_predict'](s, {SF!r}).collect()))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 500" in out.stdout, out.stderr[-2000:]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tokenize", "top_terms", "support_pairs", "conversations_summary", "dataset_profile", "quality_gate"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(QUERIES["msg_len_hist"](spark, SF))
    assert "ReadSchema: struct<text:string>" in text


def test_library_rules():
    root = pathlib.Path(entry_module.__file__).parent / "replyloom"
    for path in root.rglob("*.py"):
        code = path.read_text()
        assert "localCheckpoint" not in code and "crossJoin" not in code and "toPandas" not in code, path
