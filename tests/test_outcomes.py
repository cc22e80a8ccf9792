"""Every outcome that a query can tell apart occurs in its rows."""

import pytest

from folioscope.plans.all import QUERIES

SF = "/root/testdata/sf0.01"
OUTCOMES = {
    ("a2_movement_age", "age"): {
        "0_30_days", "31_90_days", "91_180_days", "181_365_days", "over_365_days", "future_dated", "without_movement",
    },
    ("i9_change_cycle", "outcome"): {"already_active", "queued"},
    ("i17_expire", "rule"): {"window", "session"},
    ("q3_linkage_conclusion", "conclusion"): {"CONFIRMADO", "INCONCLUSIVO"},
    ("q10_invalid_transitions", "violation"): {"not_allowed", "chain_broken"},
    ("s7_report_version", "version"): {1, 2},
    ("st1_stream_movements", "part"): {"new", "missing_lawsuit"},
    ("st2_stream_upsert", "action"): {"insert", "update"},
    ("q14_report_gate", "gate_reason"): {"batch_not_approved", "partner_not_live", "snapshot_incomplete", "review_incomplete", "link_ended", "case_inactive", None},
    ("st3_failure_limiter", "limited"): {True, False},
    ("w10_catalog_pages", "report_status"): {"atualizado", "desatualizado", "gerando", "erro"},
}


@pytest.mark.parametrize(("name", "column"), OUTCOMES)
def test_outcomes_occur(spark, name, column):
    found = {r[0] for r in QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert found >= OUTCOMES[name, column]


def test_findings_of_nested_values(spark):
    found = {r[0] for r in QUERIES["q5_scan_nested"](spark, SF).select("findings").distinct().collect()}
    assert {"cpf", "health_word", "credential_word"} <= {x for f in found for x in f.split(",")}
