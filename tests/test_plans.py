"""Plan-level properties that matter at scale (checked on the executed plans)."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def executed(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # untruncated scan details
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_filter_reaches_the_scan(spark):
    plan = executed(spark, "trend_daily_store_month")
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert any("GreaterThanOrEqual(rental_date" in p and "LessThan(rental_date" in p for p in pushed)


@pytest.mark.parametrize("name", ["kpi", "kpi_store_month", "sales_context", "report_store_difference",
                                  "store_compare", "geo_headline", "customer_value_tiers"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = executed(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["categories", "geo", "top_customers", "actors", "film_utilization"])
def test_fact_is_never_the_broadcast_side(spark, name):
    plan = executed(spark, name)
    for block in plan.split("BroadcastExchange")[1:]:
        head = block.split("\n")[0:12]
        assert not any("/fact/version=" in line and "FileScan" in line for line in head[:3]), name


def test_prune_columns(spark):
    plan = executed(spark, "trend_monthly")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(len(s.split(",")) <= 5 for s in schemas)


def test_customer_value_reads_the_fact_once(spark):
    # the mart that the ranking writes once and reads again
    from shelfline.plans.customers import customer_value
    from shelfline.sources.testdata import load_roles
    df = customer_value(load_roles(spark, SF))
    df.write.format("noop").mode("overwrite").save()
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
             if "FileScan" in x and "/fact/version=" in x]
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["geo", "countries", "chart_countries", "categories", "top_customers_by_name"])
def test_fact_is_aggregated_before_it_meets_a_dimension(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every dimension were large
    try:
        plan = executed(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    depth = [re.search(r"[A-Za-z(*]", x).start() if re.search(r"[A-Za-z(*]", x) else 0 for x in lines]
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and "/fact/version=" in x]
    assert scans
    for i in scans:
        at, over = depth[i], ""
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                if m := re.search(r"Aggregate|Join", lines[j]):
                    over = m[0]
                    break
        assert over == "Aggregate", lines[j]
