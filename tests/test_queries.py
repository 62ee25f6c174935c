"""Registered queries against their check SQL. `python tests/oracle.py` covers every key at any scale."""

import os

import pytest
from oracle import compare, connect

from tenuria.plans import catalog

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "dedup_first silver_customers silver_tickets events_to_daily customer_360 customer_360_accounts snapshots_weekly "
    "features_cohort leak_report ts_folds ordinal_split eval_by_cohort threshold_capacity evaluation_report "
    "intervention_plan waterfall_rows dq_gold cohort_heatmap engagement_box mon_psi mon_retrain velocity_alert ab_assign "
    "promotion_gate train_gbt cv_temporal contributions save_load_model top_k_multi precision_at_k_multi stream_daily_engagement"
).split()
KEYS = sorted(catalog.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_check_sql(spark, duck, key):
    assert compare(catalog.queries()[key](spark, SMALL), duck, catalog.oracle_sql()[key]) == ""


def test_every_query_has_check_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert catalog.queries().keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
