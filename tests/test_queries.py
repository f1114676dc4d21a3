"""Every registered query against its SQL, and what the entry module promises."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402
from kipimo.plans import registry  # noqa: E402

TABLES = "documents embeddings events conversations benchmark labels pages".split()


@pytest.fixture(scope="module")
def database(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, data, database, name):
    df = entry_module.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = database.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == _sorted(tuple(_plain(r[k]) for k in at) for r in result.fetchall())


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["category", "model", "mean_wer", "mean_cer"] and df.count() == 8


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry_module.queries())


def test_udfs_run_once(spark, data):
    """Unfolding an alignment must not evaluate the UDF again for a size filter."""
    expected = {"top_substitutions": 1, "top_deletions": 1, "align_runs": 1, "word_error_rate": 1}
    expected |= {"clip_accuracy": 2, "error_rows": 2, "error_totals": 1}
    for name, nodes in expected.items():
        plan = entry_module.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("ArrowEvalPython") == nodes, name


def test_top_k_is_pruned_before_the_shuffle(spark, data):
    plan = entry_module.queries()["top_deletions"](spark, data)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("WindowGroupLimit") == 2
    assert "SortAggregate" not in plan.toString()


def test_scans_read_only_needed_columns(spark, data):
    plan = entry_module.queries()["align_words"](spark, data)._jdf.queryExecution().executedPlan()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan.toString()
