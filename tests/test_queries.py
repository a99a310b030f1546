"""Every registered query equals its SQL form, and its plan keeps to the rules."""

import pytest

from compare import compare, connect
from conftest import SMALL
from riskboard import plans
from riskboard.sources import tables
from riskboard.sources.tables import Tables


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, plans.QUERIES[name], plans.SQL[name], SMALL)
    assert ok, note


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 150
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(plans.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


BATCH = [n for n in plans.QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_cross_join_or_python(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plans.QUERIES["companies_by_status"](spark, SMALL)._jdf.queryExecution().toString()
    assert "c_name" not in plan.split("Physical Plan")[-1]
    plan = plans.QUERIES["coverage_gap"](spark, SMALL)._jdf.queryExecution().toString()
    assert "text:string" not in plan.split("Physical Plan")[-1]


def test_status_filter_reaches_scan(spark):
    t = Tables(spark, SMALL)
    plan = t.read("labels").filter("toxic = 1")._jdf.queryExecution().toString()
    assert "EqualTo(toxic,1)" in plan


GROUPED = {  # query → key of its groups, and how large the largest must be at least
    "evidence_conflict": ("company_id", 2), "claim_conflict": ("claim_key", 2), "carrier_counts": ("company_id", 1), "account_top_k": ("company_id", 2),
    "keyword_findings": ("company_id", 2), "basis_resolved": ("inference_id", 2), "exposure_reach": ("start", 2),
    "dictionary_screen": ("evidence_id", 2), "feedback_as_of": ("company_id", 2), "verdict_history": ("company_id", 2),
    "snapshot_evidence": ("name", 2), "carrier_listing": ("company_id", 2), "account_listing": ("company_id", 2),
}


@pytest.mark.parametrize("name", list(GROUPED))
def test_rows_are_no_trivial_groups(spark, name):
    key, least = GROUPED[name]
    counts = plans.QUERIES[name](spark, "/root/testdata/sf0.01").groupBy(key).count()
    assert counts.agg({"count": "max"}).first()[0] >= least and counts.count() > 1


def test_queries_cut_and_join_several(spark):
    folder = "/root/testdata/sf0.01"
    t = Tables(spark, folder)
    assert tables.account(t).count() > plans.QUERIES["account_top_k"](spark, folder).count()
    assert plans.QUERIES["carrier_counts"](spark, folder).filter("n_total > 1").count() > 1
    assert plans.QUERIES["section_counts"](spark, folder).filter("n > 5").count() > 3
    assert plans.QUERIES["keyword_text"](spark, folder).filter("keyword_text like '%；%'").count() > 1
    assert {r["metric"]: r["value"] for r in plans.QUERIES["quality_kpis"](spark, folder).collect()}["citation_completeness"] >= 0
    support = plans.QUERIES["basis_support"](spark, folder)
    assert support.filter("n_resolved > 1").count() > 1
    covered = plans.QUERIES["coverage_gap"](spark, folder)
    assert covered.count() > 1
    machine = plans.QUERIES["stream_task_machine"](spark, folder)
    assert machine.filter("refused > 0").count() > 1 and machine.filter("expired > 0").count() > 1
