"""Jobs over well-packed columns keep a named number of tasks; shared steps run once."""

import re

import pytest

from folioscope.operators.status import approval_blocked
from folioscope.plans.all import QUERIES
from tests.compare import TESTDATA


def plan(spark, name):
    return QUERIES[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("r6_manifest_complete", "l_orderkey"),
        ("r5_proposals", "l_orderkey"),
        ("f9_portfolio_enrichment", "case_id"),
        ("i6_missing_references", "case_id"),
    ],
)
def test_rows_are_dealt_to_a_named_number_of_tasks(spark, name, key):
    assert re.search(rf"Exchange hashpartitioning\({key}#\d+L?, \d+\), REPARTITION_BY_NUM", plan(spark, name))


def test_only_items_that_corrections_may_settle_go_by_their_id(spark):
    def rows(schema):
        return spark.createDataFrame([], schema)

    batches = rows(
        "batch_id long, state string, partner_id long, period_start date, period_end date, parsed_item_count long,"
        " processing_status string, processing_finished_at timestamp"
    )
    runs = rows("run_id long, batch_id long, created_at timestamp")
    items = rows("item_id string, batch_id long, run_id long, status string, quality_flags array<string>")
    reviews = rows("review_id string, item_id string, batch_id long, run_id long, review_revision long, decision string, created_at timestamp")
    shown = approval_blocked(batches, runs, items, reviews)._jdf.queryExecution().optimizedPlan().toString()
    assert any(re.search(r"Filter .*NOT \(status#\d+ = matched\)", line) for line in shown.splitlines())


def test_the_catalog_is_derived_once(spark):
    shown = plan(spark, "w10_catalog_pages")
    assert "catalog-" in shown and "orders.parquet" not in shown
