"""Every registered query against its SQL, at the smallest scale."""

import compare
import pytest

import __spark_entry__ as contract
from turnaround.operators import analysis, findings, profiling, quantiles

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, connection, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize(
    "name",
    ["findings_overall", "resolution_stats", "profile_describe", "findings_by_problem", "borough_comparison",
     "channel_comparison", "shared_scale", "profile_top_values", "reconcile_counts", "findings_json", "charts_of_one_scan"],
)
def test_one_scan_of_the_fact_table(spark, sf_dir, monkeypatch, name):
    plans, store = [], quantiles.materialize

    def recorded(df, label):
        plans.append(df)
        return store(df, label)

    for module in (quantiles, findings, profiling, analysis):
        monkeypatch.setattr(module, "materialize", recorded)
    plans.append(QUERIES[name](spark, sf_dir))
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum(t.count("events.parquet]") for t in texts) == 1


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.agency for r in rows} == {"HPD", "NYPD", "DSNY", "DOT", "DEP"}
