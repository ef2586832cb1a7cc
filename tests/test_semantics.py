"""Semantic traps of the reference marts on hand-written rows (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from fixtures import D, roles_of, ts
from shelfline.functions import dates
from shelfline.operators import cells
from shelfline.operators.filters import Filters
from shelfline.plans import customers as cu
from shelfline.plans import inventory as inv
from shelfline.plans import leaderboards as lb
from shelfline.plans import overview as ov
from shelfline.plans import patterns as pa
from shelfline.plans import share as sh
from shelfline.plans import trend as tr


def rental(rid, date, inv_id=1, cust=1):
    return (rid, ts(date), ts(date), inv_id, cust, "s1")


def test_fan_out(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")], payment=[(1, D("2.00")), (1, D("3.00"))])
    k = ov.kpi(roles).collect()[0]
    assert k.rentals == 1 and k.revenue == 5.0
    t = ov.trend(roles).collect()[0]
    assert t.rentals == 2 and t.revenue == 5.0


def test_unpaid_rental_coalesce_vs_null(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")])
    assert ov.kpi(roles).collect()[0].revenue == 0.0
    assert ov.store_summary(roles).collect()[0].revenue is None


def test_null_sorts_first_descending(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05", cust=1), rental(2, "2024-01-05", cust=2),
                                    rental(3, "2024-01-05", cust=3)],
                     payment=[(1, D("5.00")), (3, D("7.00"))])
    got = [r.total_spent for r in cu.customers_list(roles).collect()]
    assert got == [None, 7.0, 5.0]


def test_unit_never_rented_in_month(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-02-05")])
    rows = {r.title: r for r in inv.film_utilization(roles, Filters.of(None, "2024-01")).collect()}
    assert rows["Alpha"].copies == 2 and rows["Alpha"].times_rented == 0 and rows["Alpha"].util_rate == 0.0


def test_two_actors_one_rental(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")], payment=[(1, D("1.00"))])
    got = {r.actor: r.total_rentals for r in lb.actors(roles).collect()}
    assert got == {"Ann A": 1, "Bob B": 1}


def test_absent_store_is_zero(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")], payment=[(1, D("1.00"))])
    got = {r.store: (r.revenue, r.rentals, r.customers) for r in ov.store_compare(roles).collect()}
    assert got == {"Store 1": (1.0, 1, 1), "Store 2": (0.0, 0, 0)}


def test_kpi_month_without_rentals(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")], payment=[(1, D("1.00"))])
    k = ov.kpi(roles, Filters.of(None, "2023-05")).collect()[0]
    assert (k.inventory, k.films, k.avg_tx, k.rentals) == (3, 2, 0.0, 0)


def test_segment_edges(spark):
    df = spark.createDataFrame([(n,) for n in (19, 20, 29, 30, 40, 41)], "n int")
    got = [r.s for r in df.select(cu.segment_of("n").alias("s")).collect()]
    assert got == ["4. Casual (<20)", "3. Regular (20-29)", "3. Regular (20-29)",
                   "2. Frequent (30-40)", "2. Frequent (30-40)", "1. Elite (40+)"]


def _value_roles(spark, amounts):
    rentals = [rental(i + 1, "2024-01-05", cust=(i % 3) + 1) for i in range(len(amounts))]
    return roles_of(spark, rental=rentals, payment=[(i + 1, D(a)) for i, a in enumerate(amounts)])


def test_qcut_tiers(spark):
    cust = [(i, "C", str(i), 1) for i in range(1, 6)]
    rentals = [rental(i, "2024-01-05", cust=i) for i in range(1, 6)]
    pays = [(i, D(a)) for i, a in zip(range(1, 6), [1, 2, 3, 10, 11])]
    roles = roles_of(spark, customer=cust, rental=rentals, payment=pays)
    got = {r.tier_ord: r.customers for r in cu.customer_value_tiers(roles).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_qcut_collapse_everyone_mid(spark):
    cust = [(i, "C", str(i), 1) for i in range(1, 4)]
    rentals = [rental(i, "2024-01-05", cust=i) for i in range(1, 4)]
    roles = roles_of(spark, customer=cust, rental=rentals, payment=[(i, D(4)) for i in range(1, 4)])
    got = [(r.tier, r.customers) for r in cu.customer_value_tiers(roles).collect()]
    assert got == [("🥈 Mid Value", 3)]


def test_percent_rank_ties(spark):
    cust = [(i, "C", str(i), 1) for i in range(1, 4)]
    rentals = [rental(i, "2024-01-05", cust=i) for i in range(1, 4)]
    pays = [(1, D(3)), (2, D(5)), (3, D(5))]
    roles = roles_of(spark, customer=cust, rental=rentals, payment=pays)
    got = {r.tier: r.customers for r in cu.customer_value_tiers_pr(roles).collect()}
    assert got == {"🥉 Low Value": 1, "🥈 Mid Value": 2}


def test_day_and_hour_labels(spark):
    df = spark.createDataFrame([(ts("2024-01-07 00:00:00"),)], "t timestamp")
    r = df.select(dates.dow("t").alias("d"), dates.day_short(dates.dow("t")).alias("s"),
                  dates.day_name("t").alias("n")).collect()[0]
    assert (r.d, r.s, r.n) == (0, "Sun", "Sunday")
    h = spark.createDataFrame([(x,) for x in (0, 9, 12, 17)], "h int")
    assert [r.a for r in h.select(dates.ampm_label("h").alias("a")).collect()] == ["0AM", "9AM", "12PM", "5PM"]
    assert [r.a for r in h.select(dates.hour_label("h").alias("a")).collect()] == ["00:00", "09:00", "12:00", "17:00"]


def test_peak_hour_tie_takes_lowest(spark):
    acts = [(ts("2024-01-01 03:10:00"), 1, D(1)), (ts("2024-01-01 08:10:00"), 1, D(1))]
    roles = roles_of(spark)
    roles = roles.__class__(**{**roles.__dict__, "activity": spark.createDataFrame([(*x, 1) for x in acts], "ts timestamp, customer_id bigint, amount decimal(12,2), rows bigint")})
    assert pa.peaks(roles).collect()[0].peak_hour == 3


def test_change_percent_denominator_one(spark):
    rentals = [rental(1, "2024-01-05"), rental(2, "2024-02-05")]
    roles = roles_of(spark, rental=rentals, payment=[(1, D("0.50")), (2, D("2.00"))])
    got = {r.month: r.change_pct for r in tr.monthly_revenue(roles).collect()}
    assert got == {"2024-01": None, "2024-02": 150.0}


def test_month_filter_is_pushed_as_range(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-31 23:59:59"), rental(2, "2024-02-01")])
    n = ov.trend(roles, Filters.of(None, "2024-01")).agg(F.sum("rentals")).collect()[0][0]
    assert n == 1


def test_hour_patterns_follow_store_and_payment_fan_out(spark):
    rentals = [rental(1, "2024-01-05 08:00:00"), rental(2, "2024-01-05 09:00:00")]
    roles = roles_of(spark, rental=rentals, payment=[(1, D("1.00")), (1, D("2.00"))],
                     inventory=[(1, 1, 1), (2, 1, 1), (3, 2, 2)])
    cells = {(r.hour, r.rentals, r.revenue) for r in pa.hour_dow_cube(roles).collect()}
    assert cells == {(8, 2, 3.0), (9, 1, 0.0)}  # two payments make two joined rows
    bare = {r.label: r.value for r in sh.share(roles, "chart-hourly").collect()}
    assert bare == {"08:00": 1.0, "09:00": 1.0}
    assert pa.hour_dow_cube(roles, Filters.of(2)).count() == 0
    assert pa.peaks(roles, Filters.of(2)).collect()[0].peak_day == "N/A"


def test_ratios_without_payment_or_spread(spark):
    roles = roles_of(spark, rental=[rental(1, "2024-01-05")])
    assert [r.percent for r in sh.share(roles, "chart-store-rev").collect()] == [None]
    roles = roles_of(spark, rental=[rental(1, "2024-01-05"), rental(2, "2024-02-05")], payment=[(1, D("2.00")), (2, D("2.00"))])
    months = [r for r in tr.unusual(roles).collect() if r.kind == "month"]
    assert [(r.z, r.unusual) for r in months] == [(None, False)] * 2


def test_durations_beyond_a_long_of_microseconds(spark):
    roles = roles_of(spark, rental=[(k, ts("1000-01-05"), ts("9000-01-05"), 1, 1, "s1") for k in range(60)])
    hours = 24.0 * (ts("9000-01-05") - ts("1000-01-05")).days
    assert [r.avg_hours for r in pa.avg_duration_by_dow(roles).collect()] == [hours]
    assert [r.percent for r in sh.share(roles, "chart-avg-dur").collect()] == [100.0]
    fact = roles.rental.select("rental_date", "return_date", F.lit(1).alias("store_id"), F.lit(100001).alias("rental_month"),
                               F.lit(1).cast("long").alias("rows"), F.lit(True).alias("rental_first"), F.lit(D("1.00")).alias("paid"))
    assert [int(r.micros) for r in cells.rental_cells(fact).collect()] == [60 * int(hours) * 3_600_000_000]


def test_actors_count_each_film_once(spark):
    pairs = [(1, 100), (1, 100), (2, 100), (1, 101), (1, None), (2, None), (None, 101), (9, 101)]
    roles = roles_of(spark, film_actor=pairs, rental=[rental(1, "2024-01-05"), rental(2, "2024-01-06", inv_id=3)], payment=[(1, D("2.00"))])
    df = lb.actors(roles)
    assert sorted(tuple(r) for r in df.select("films", "total_rentals", "revenue").collect()) == [(1, 1, 2.0), (2, 3, 4.0)]
    # no hash table of pairs
    by_actor = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [actor_id" in x]
    assert by_actor and not any("distinct" in x for x in by_actor)
