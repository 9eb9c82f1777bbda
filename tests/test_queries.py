"""Every registered query against its DuckDB text, the entry point, and the library without the training-data part."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import queries, system_queries

AT = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(AT):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{AT}/{name}'")
    return c


assert system_queries  # registers its queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, AT), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_nothing_is_left_out(spark, duck):
    run = lambda name: queries.QUERIES[name](spark, AT)
    events, users, customers, orders = (duck.sql(q).fetchall()[0][0] for q in ("SELECT count(*) FROM events", "SELECT count(DISTINCT user_id) FROM events", "SELECT count(*) FROM customer", "SELECT count(*) FROM orders"))
    assert run("write_too_old").count() == run("write_intent_conflict").count() == events
    assert run("quorum_commit_index").count() == users and run("insert_upsert").count() == orders + customers
    assert run("reverse_scan").count() == run("as_of_scan").count() > 5


def test_time_bounds_reach_the_files(spark):
    for name in ("as_of_scan", "as_of_multi_t", "range_scan", "kv_get_many"):
        plan = queries.QUERIES[name](spark, AT)._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(ts," in plan, name


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stderr == ""


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(f"{ROOT}/palimpsest"):
        if "llm" not in folder.split(os.sep):
            assert not [n for n in names if n.endswith(".py") and re.search(r"\bllm\b", open(os.path.join(folder, n)).read())]
