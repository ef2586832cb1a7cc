"""Registered queries against their DuckDB oracle at sf0.01 (a representative subset;
tools/oracle_check.py runs all of them)."""

import os

import pytest

from tools.oracle_check import compare

SF = "/root/testdata/sf0.01"
SUBSET = ["kpi_store_month", "store_compare", "trend_monthly", "categories", "film_utilization_store_month",
          "customer_segments", "top_customers", "customer_value_tiers", "customer_value_tiers_pr", "geo_headline",
          "hour_dow_cube", "avg_duration_by_dow", "actors_thresholds", "customers_list_filtered", "films_filtered",
          "category_catalog", "monthly_revenue", "revenue_drops", "share_cust_val", "sales_context",
          "forecast_panel_customer", "forecast_ma_metrics_store", "text_intents", "text_parameters",
          "report_context", "adhoc_select"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_oracle_subset(spark):
    res = compare(spark, SF, SUBSET, verbose=False)
    bad = {k: v for k, v in res.items() if not v.startswith("ok")}
    assert not bad, bad


def test_every_query_has_entry_and_oracle_names_match():
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 120
