"""Text reports assembled from the marts.

A report is a DataFrame of lines ``(section_ord, rank, line)``: each section is
a small mart formatted with ``format_number`` (half-even on the binary value,
like Python's ``format``), and sections are stacked with ``unionByName``.  A
caller renders it by ordering on (section_ord, rank); the frames are bounded
by the marts they come from (stores, months, top-k lists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ampm_label
from ..functions.money import zero_if_null
from ..operators.fact import distinct_rentals, paid_rentals
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import top_k
from ..plans import customers as cu
from ..plans import geo as ge
from ..plans import inventory as inv
from ..plans import overview as ov
from ..plans import patterns as pa
from ..plans import trend as tr
from ..sources.roles import Roles
from .bundle import answers


def money_txt(c) -> Column:
    """'$1,234.50' (Python ``f"${x:,.2f}"``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))


def plain2(c) -> Column:
    """'1234.50' (``f"{x:.2f}"``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.format_number(c.cast("double"), 2), ",", "")


def plain1(c) -> Column:
    """'-12.3' (``f"{x:.1f}"``, no thousands separator)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.format_number(c.cast("double"), 1), ",", "")


def int_txt(c) -> Column:
    """'1,234' (``f"{n:,}"``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_number(c.cast("bigint"), 0)


def _section(df: DataFrame, ord_: int, header: str, line: Column, order: list[Column]) -> DataFrame:
    """Header (rank 0) plus one ranked line per row; ``df`` is a bounded mart."""
    w = Window.orderBy(*order)
    body = df.select(F.lit(ord_).alias("section_ord"), F.row_number().over(w).alias("rank"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(ord_, 0, header)], "section_ord int, rank int, line string")
    return head.unionByName(body)


def _fixed(spark, ord_: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(ord_, i, s) for i, s in enumerate(lines)],
                                 "section_ord int, rank int, line string")


def context_report(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """The sectioned context report (KPIs, stores, months, categories, top
    customers, countries, peak hours, weekdays)."""
    spark = roles.stores.sparkSession
    store_s = "All" if f.store is None else str(f.store)
    month_s = "All" if f.month is None else f.month
    k = ov.kpi(roles, f)
    kpi_lines = k.select(F.array(
        F.concat(F.lit("Total Revenue: "), money_txt("revenue")),
        F.concat(F.lit("Total Customers: "), int_txt("customers")),
        F.concat(F.lit("Total Rentals: "), int_txt("rentals")),
        F.concat(F.lit("Inventory Items: "), int_txt("inventory")),
        F.concat(F.lit("Film Titles: "), F.col("films").cast("string")),
        F.concat(F.lit("Avg Revenue per Rental: $"), plain2("avg_tx"))).alias("a"))
    kpi = kpi_lines.select(F.lit(1).alias("section_ord"), F.posexplode("a").alias("pos", "line")) \
        .select("section_ord", (F.col("pos") + 1).cast("int").alias("rank"), "line")
    parts = [
        _fixed(spark, 0, [f"=== REAL-TIME DASHBOARD DATA (Filter: Store={store_s}, Month={month_s}) ==="]),
        _fixed(spark, 1, ["[KEY PERFORMANCE INDICATORS]"]), kpi,
    ]
    store_fact = paid_rentals(roles, f.without_store())
    stores = (store_fact.groupBy("store_id")
              .agg(zero_if_null(F.sum("paid")).alias("rev"), distinct_rentals(store_fact).alias("n"),
                   F.countDistinct("customer_id").alias("c")))
    parts.append(_section(stores, 2, "[STORE COMPARISON — both stores, month filter applied]",
                          F.concat(F.lit("  Store "), F.col("store_id").cast("string"), F.lit(": Revenue="),
                                   money_txt(F.round("rev", 2)), F.lit(", Rentals="), int_txt("n"),
                                   F.lit(", Customers="), F.col("c").cast("string")), [F.col("store_id")]))
    months = tr.monthly_trend(roles, f)
    parts.append(_section(months, 3, "[MONTHLY REVENUE TREND]",
                          F.concat(F.lit("  "), F.col("month"), F.lit(": Revenue="), money_txt("revenue"),
                                   F.lit(", Rentals="), F.col("rentals").cast("string")), [F.col("month")]))
    cats = inv.categories(roles, f)
    parts.append(_section(cats, 4, "[CATEGORIES BY REVENUE]",
                          F.concat(F.lit("  #"), F.row_number().over(Window.orderBy(F.col("revenue").desc(), "category"))
                                   .cast("string"), F.lit(" "), F.col("category"), F.lit(": Revenue="),
                                   money_txt("revenue"), F.lit(", Rentals="), F.col("rentals").cast("string"),
                                   F.lit(", Rev/Inventory=$"), plain2("rev_per_inv")),
                          [F.col("revenue").desc(), F.col("category")]))
    topc = cu.top_customers_by_name(roles, f, 10)
    parts.append(_section(topc, 5, "[TOP 10 CUSTOMERS BY REVENUE]",
                          F.concat(F.lit("  #"), F.row_number().over(Window.orderBy(F.col("revenue").desc(), "name"))
                                   .cast("string"), F.lit(" "), F.col("name"), F.lit(": Revenue="), money_txt("revenue"),
                                   F.lit(", Rentals="), F.col("rentals").cast("string"), F.lit(", Last Rental="),
                                   F.col("last_rental").cast("string")),
                          [F.col("revenue").desc(), F.col("name")]))
    geo = ge.geo_top(roles, f, 10)
    parts.append(_section(geo, 6, "[TOP 10 COUNTRIES BY REVENUE]",
                          F.concat(F.lit("  #"), F.row_number().over(Window.orderBy(F.col("revenue").desc(), "country"))
                                   .cast("string"), F.lit(" "), F.col("country"), F.lit(": Revenue="),
                                   money_txt("revenue"), F.lit(", Customers="), F.col("customers").cast("string")),
                          [F.col("revenue").desc(), F.col("country")]))
    hours = pa.peak_hours(roles, f, 5)
    parts.append(_section(hours, 7, "[PEAK HOURS (by rental count)]",
                          F.concat(F.lit("  "), ampm_label("hour"), F.lit(" (hour "), F.col("hour").cast("string"),
                                   F.lit("): "), F.col("rentals").cast("string"), F.lit(" rentals, Revenue="),
                                   money_txt("revenue")),
                          [F.col("rentals").desc(), F.col("hour")]))
    days = pa.days(roles, f)
    parts.append(_section(days, 8, "[REVENUE BY DAY OF WEEK]",
                          F.concat(F.lit("  "), F.col("day_name"), F.lit(": "), F.col("rentals").cast("string"),
                                   F.lit(" rentals, Revenue="), money_txt("revenue")),
                          [F.col("rentals").desc(), F.col("dow")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store_performance(roles: Roles) -> DataFrame:
    """R2: store table (revenue descending, nulls first), total and leader share."""
    s = answers(roles)["store_summary"]
    order = [F.col("revenue").desc_nulls_first(), F.col("store")]
    table = _section(s, 1, "| Store | Revenue | Rentals | Customers |",
                     F.concat(F.lit("| **"), F.col("store"), F.lit("** | **"), money_txt("revenue"), F.lit("** | "),
                              int_txt("rentals"), F.lit(" | "), int_txt("customers"), F.lit(" |")), order)
    total = s.agg(F.sum("revenue")).scalar()
    lead = top_k(s, order, 1).select("store", "revenue")
    summary = (lead.withColumn("t", total)
               .select(F.lit(0).alias("section_ord"), F.lit(0).alias("rank"),
                       F.concat(F.lit("Total Revenue: "), money_txt(F.round("t", 2)), F.lit(" | Leader: "), F.col("store"),
                                F.lit(" with "), money_txt("revenue"), F.lit(" ("),
                                F.format_number(F.col("revenue") / F.col("t") * 100, 1), F.lit("% of total)"))
                       .alias("line")))
    return summary.unionByName(table)


def last_months(roles: Roles, k: int = 4) -> DataFrame:
    """Last k months with the change vs the previous one (▲/▼)."""
    lp = tr.last_periods(roles, k)
    arrow = F.when(F.col("change_pct") > 0, F.lit("▲")).otherwise(F.lit("▼"))
    line = F.when(F.col("change_pct").isNull(),
                  F.concat(F.lit("| "), F.col("month"), F.lit(" | "), money_txt("revenue"), F.lit(" | — |"))) \
        .otherwise(F.concat(F.lit("| **"), F.col("month"), F.lit("** | **"), money_txt("revenue"), F.lit("** | "),
                            arrow, F.lit(" "), F.format_number(F.abs("change_pct"), 1), F.lit("% |")))
    return _section(lp, 0, "| Month | Revenue | vs Prev |", line, [F.col("month")])


# Rank medals of the category table.
MEDALS = ["🥇", "🥈", "🥉", "4️⃣", "5️⃣"]


def category_ranking(roles: Roles, k: int = 5) -> DataFrame:
    """Ranked categories with medals."""
    rc = answers(roles)["ranked_categories"] if k == 5 else tr.ranked_categories(roles, k)
    medal = F.element_at(F.array(*[F.lit(m) for m in MEDALS]), F.col("rank").cast("int"))
    line = F.concat(F.lit("| "), F.coalesce(medal, F.col("rank").cast("string")), F.lit(" | **"), F.col("category"),
                    F.lit("** | **"), money_txt("revenue"), F.lit("** | "), int_txt("rentals"), F.lit(" |"))
    return _section(rc, 0, "| Rank | Category | Revenue | Rentals |", line, [F.col("rank")])


def recent_summary(roles: Roles, k: int = 3) -> DataFrame:
    """The last k months and the current direction."""
    rt = tr.recent_trend(roles, k)
    lines = _section(rt, 1, f"Recent trend (last {k} months):",
                     F.concat(F.lit("- **"), F.col("month"), F.lit("**: "), money_txt("revenue")),
                     [F.col("pos").desc()])
    head = top_k(rt, [F.col("pos")], 1).select(
        F.lit(0).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("Revenue is currently "), F.col("direction"), F.lit(" ("),
                 F.format_number(F.abs("change_pct"), 1), F.lit("% vs previous month)")).alias("line"))
    return head.unionByName(lines)


def result_heading(found: DataFrame, label: str, shown: int = 30) -> DataFrame:
    """The lines above a result: its label and 'Showing top n of N' or 'N results', or that there are none.
    ``found`` is the whole result; it is only counted."""
    n = F.col("n")
    # The texts of the result heading.
    lines = F.when(n == 0, F.array(F.lit("📊 **No results found.**"), F.lit(f"*{label}*"))).otherwise(F.array(
        F.lit(f"## 👥 {label}"),
        F.concat(F.lit("*"), F.when(n > shown, F.concat(F.lit(f"Showing top {shown} of "), n.cast("string")))
                 .otherwise(F.concat(n.cast("string"), F.lit(" result"), F.when(n != 1, "s").otherwise(""))), F.lit(" found*"))))
    return (found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("section_ord"), F.posexplode(lines).alias("rank", "line"))
            .select("section_ord", F.col("rank").cast("int").alias("rank"), "line"))


def render_table(df: DataFrame, order: list[Column], money_pattern: str = "spent|revenue|rate|avg_rate") -> DataFrame:
    """A capped result as table lines: row number, money columns (by name) as
    '**$x.xx**', nulls as '—', other values as text.  ``df`` is already limited."""
    import re
    cols = df.columns
    header = "| # | " + " | ".join(re.sub(r"\b\w", lambda m: m.group(0).upper(), c.replace("_", " ")) for c in cols) + " |"
    num_types = ("double", "float", "decimal", "int", "bigint", "smallint")
    vals = []
    for c in cols:
        dtype = df.schema[c].dataType.simpleString()
        if re.search(money_pattern, c) and dtype.startswith(num_types):
            v = F.concat(F.lit("**$"), plain2(c), F.lit("**"))
        else:
            v = F.col(c).cast("string")
        vals.append(F.coalesce(v, F.lit("—")))
    w = Window.orderBy(*order)
    line = F.concat(F.lit("| "), F.row_number().over(w).cast("string"), F.lit(" | "),
                    F.concat_ws(" | ", *vals), F.lit(" |"))
    return _section(df, 0, header, line, order)


def recommendations(roles: Roles, slow_below: int = 5) -> DataFrame:
    """The fact-bearing lines of the recommendations text (top category, slow titles)."""
    from ..plans.context import sales_context
    c = sales_context(roles, slow_below, answers(roles))
    titles = F.when(F.col("slow_titles") == "several titles", F.col("slow_titles")).otherwise(
        F.concat(F.lit("*"), F.regexp_replace("slow_titles", ", ", "*, *"), F.lit("*")))
    lines = c.select(F.array(
        F.lit("## 🎯 5 Recommendations to Increase Sales"),
        F.concat(F.lit("**1. 🏆 Double down on "), F.col("top_category"), F.lit("**")),
        F.concat(F.lit("   → Titles like "), titles, F.lit(f" have <{slow_below} rentals."))).alias("a"))
    return lines.select(F.lit(0).alias("section_ord"), F.posexplode("a").alias("rank", "line")) \
        .select("section_ord", F.col("rank").cast("int").alias("rank"), "line")


def patterns_report(roles: Roles, k: int = 3) -> DataFrame:
    """Busiest hours and weekdays tables with the peak lines."""
    stored = answers(roles) if k == 3 else {"peak_hours": pa.peak_hours_all(roles, k), "best_days": pa.best_days_all(roles, k)}
    hours, days = stored["peak_hours"], stored["best_days"]
    h = _section(hours, 1, "| Hour | Rentals |",
                 F.concat(F.lit("| **"), F.col("hour").cast("string"), F.lit(":00** | "), int_txt("rentals"), F.lit(" |")),
                 [F.col("rentals").desc(), F.col("hour")])
    d = _section(days, 3, "| Day | Rentals |",
                 F.concat(F.lit("| **"), F.col("day"), F.lit("** | "), int_txt("rentals"), F.lit(" |")),
                 [F.col("rentals").desc(), F.col("dow")])
    ph = top_k(hours, [F.col("rentals").desc(), F.col("hour")], 1).select(
        F.lit(2).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("🕐 **Peak time: "), F.col("hour").cast("string"), F.lit(":00–"),
                 (F.col("hour") + 1).cast("string"), F.lit(":00**")).alias("line"))
    pd_ = top_k(days, [F.col("rentals").desc(), F.col("dow")], 1).select(
        F.lit(4).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("📅 **Best day: "), F.col("day"), F.lit("**")).alias("line"))
    return h.unionByName(ph).unionByName(d).unionByName(pd_)


def trend_report(roles: Roles, cutoff: float = 1000.0, drop: float = -10.0) -> DataFrame:
    """Positive months with peak / data-cutoff notes, the biggest drop, the peak
    and the latest change."""
    m = answers(roles)["monthly_revenue"].where(F.col("revenue") > 0)
    peak = F.max("revenue").over(Window.partitionBy())  # one row per month: bounded
    w = Window.orderBy("month")
    prev = F.lag("revenue").over(w)
    t = m.select("month", "revenue", (F.col("revenue") == peak).alias("_peak"),
                 F.lag("month").over(w).alias("prev_month"),
                 ((F.col("revenue") - prev) / F.greatest(prev, F.lit(1)) * 100).alias("_chg"))
    note = (F.when(F.col("_peak"), F.lit("🏆 Peak"))
            .when(F.col("revenue") < cutoff, F.lit("⚠️ Data cutoff")).otherwise(F.lit("")))
    table = _section(t, 1, "| Month | Revenue | Note |",
                     F.concat(F.lit("| "), F.col("month"), F.lit(" | **"), money_txt("revenue"), F.lit("** | "),
                              note, F.lit(" |")), [F.col("month")])
    drops = t.where(F.col("_chg") < drop)
    biggest = top_k(drops, [F.col("_chg"), F.col("month")], 1).select(
        F.lit(2).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("**Biggest drop:** "), F.col("month"), F.lit(" ("), plain1("_chg"),
                 F.lit("% vs "), F.col("prev_month"), F.lit(")")).alias("line"))
    pk = top_k(t, [F.col("revenue").desc(), F.col("month")], 1).select(
        F.lit(3).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("**Peak month: "), F.col("month"), F.lit("** → **"), money_txt("revenue"), F.lit("**")).alias("line"))
    last = top_k(t, [F.col("month").desc()], 1).where(F.col("_chg").isNotNull()).select(
        F.lit(4).alias("section_ord"), F.lit(0).alias("rank"),
        F.concat(F.lit("Most recent valid month ("), F.col("month"), F.lit(") "),
                 F.when(F.col("_chg") > 0, F.lit("📈 increased")).otherwise(F.lit("📉 decreased")),
                 F.lit(" by **"), plain1(F.abs(F.col("_chg"))),
                 F.lit("%** vs previous month.")).alias("line"))
    return table.unionByName(biggest).unionByName(pk).unionByName(last)


def store_difference(roles: Roles) -> DataFrame:
    """The two leading stores side by side: revenue, rentals, revenue per rental,
    and which one has more rentals and which more revenue."""
    s = answers(roles)["store_summary"]
    two = top_k(s, [F.col("revenue").desc_nulls_first(), F.col("store")], 2)
    w = Window.orderBy(F.col("revenue").desc_nulls_first(), F.col("store"))
    p = two.select("*", F.row_number().over(w).alias("_i"))
    # pivot the two rows into one by conditional aggregation (no self join)
    pick = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{'ab'[i - 1]}_{c}")
    j = p.agg(*[pick(i, c) for i in (1, 2) for c in ("store", "revenue", "rentals")])
    rpr = lambda r, n: plain2(F.round(F.col(r) / F.greatest(F.col(n), F.lit(1)), 2))
    more_rent = F.when(F.col("a_rentals") > F.col("b_rentals"), F.col("a_store")).otherwise(F.col("b_store"))
    more_rev = F.when(F.col("a_revenue") > F.col("b_revenue"), F.col("a_store")).otherwise(F.col("b_store"))
    lines = j.select(F.array(
        F.concat(F.lit("| | "), F.col("a_store"), F.lit(" | "), F.col("b_store"), F.lit(" |")),
        F.concat(F.lit("| **Revenue** | "), money_txt("a_revenue"), F.lit(" | "), money_txt("b_revenue"), F.lit(" |")),
        F.concat(F.lit("| **Rentals** | "), int_txt("a_rentals"), F.lit(" | "), int_txt("b_rentals"), F.lit(" |")),
        F.concat(F.lit("| **Rev/Rental** | $"), rpr("a_revenue", "a_rentals"), F.lit(" | $"),
                 rpr("b_revenue", "b_rentals"), F.lit(" |")),
        F.concat(F.lit("**"), more_rent, F.lit("** has more rentals but **"), more_rev,
                 F.lit("** generates more revenue."))).alias("a"))
    return lines.select(F.lit(0).alias("section_ord"), F.posexplode("a").alias("rank", "line")) \
        .select("section_ord", F.col("rank").cast("int").alias("rank"), "line")
