"""Every registered query against its SQL, over whole tables."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from compare import difference, oracle_connection

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# Tested against brute force in tests/llm, if they are there at all.
LLM = re.compile(r"op\d+_|pipeline$")
QUERIES = {name: query for name, query in QUERIES.items() if not LLM.match(name)}
ORACLES = {name: sql for name, sql in ORACLES.items() if not LLM.match(name)}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, sf_dir, connection, name):
    assert difference(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_a_second_run_of_a_query_gives_the_same_rows(spark, sf_dir):
    runs = [QUERIES["index_list"](spark, sf_dir).collect() for _ in range(2)]
    assert sorted(runs[0]) == sorted(runs[1])


def test_the_matched_index_does_not_depend_on_the_queries_before(spark, sf_dir, connection, tmp_path):
    data = tmp_path / "data"
    data.symlink_to(sf_dir)
    for name in ("index_match", "scalar_search_none", "index_match"):
        assert difference(QUERIES[name](spark, str(data)), connection, ORACLES[name]) is None


def test_entry_returns_the_ten_nearest(spark):
    rows = entry_module.entry(spark).collect()
    assert [row["rank"] for row in rows] == list(range(1, 11))
    assert rows[0]["vec_id"] == 0 and rows[0]["distance"] == 0.0


def test_entry_can_be_imported_before_a_session_exists():
    root = str(Path(entry_module.__file__).parent)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    known = [str(len(entry_module.queries())), str(len(entry_module.oracle_sql()))]
    assert done.stdout.split() == known, done.stderr
