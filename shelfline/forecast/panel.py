"""Panel set-up: many monthly series at once, distributed by ``series_id``.

Steps (all per series, as window functions partitioned by series):

* F1 monthly series from rental ⟕ payment, positive months only
* F2 eligibility: at least 4 points, the rest goes to a rejects table
* F3 horizon clamp 1..6
* F4 adaptive lag length k = min(max(3, min(6, n // 2)), n - 2), then min(k, max(1, n - 3))
* F5 min-max scale per series (constant series -> 0); models scale by the training part (tmin, tmax)
* F6 sliding windows: for every point t >= k the previous k values (oldest first)
* F7 chronological split of the m = n - k windows: train = max(1, min(int(0.8 m), m - 2))
* F8 forecast bounds [0.3 min, 2.5 max]

A series is one row per month, so a group is bounded by the calendar span
(hundreds of rows at most), never by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..operators.cells import facts
from ..operators.fact import bare_paid_rentals, paid_rentals
from ..sources.roles import Roles

MAX_LAGS = 6
MIN_POINTS = 4


def clamp_horizon(h) -> int:
    """default 3, clamped to 1..6; unparsable -> 3."""
    try:
        return max(1, min(int(h), 6))
    except (TypeError, ValueError):
        return 3


def monthly_series(roles: Roles, by: str = "all") -> DataFrame:
    """(series_id, period, y) with y = monthly revenue > 0.

    ``by``: 'all' (the reference's single series, rental ⟕ payment), 'store',
    'customer', 'category' or 'film'."""
    if by in ("all", "store"):  # from the stored cells
        base = facts(roles, joined=by == "store").withColumn("rental_date", F.concat("month", F.lit("-01")))
        key = F.lit("all") if by == "all" else F.col("store_id").cast("string")
    elif by == "customer":
        base, key = bare_paid_rentals(roles), F.col("customer_id").cast("string")
    elif by == "film":
        base, key = paid_rentals(roles), F.col("film_id").cast("string")
    elif by == "category":
        fc = roles.film_category.join(roles.category, "category_id").select("film_id", "name")
        per_film = paid_rentals(roles).groupBy("film_id", month_start("rental_date").alias("rental_date")).agg(F.sum("paid").alias("paid"))
        base, key = per_film.join(fc, "film_id"), F.col("name")
    else:
        raise ValueError(f"unknown series key {by!r}")
    m = (base.groupBy(key.alias("series_id"), month_start("rental_date").alias("period"))
         .agg(F.coalesce(F.sum("paid"), F.lit(0)).alias("_rev")))
    return m.where(F.col("_rev") > 0).select("series_id", "period", F.col("_rev").cast("double").alias("y"))


def lag_length(n):
    """F4 as a column expression."""
    k = F.least(F.greatest(F.lit(3), F.least(F.lit(6), F.floor(n / 2))), n - 2)
    return F.least(k, F.greatest(F.lit(1), n - 3)).cast("int")


def prepare(series: DataFrame) -> DataFrame:
    """Per point: t, n, k, windows m, split, min/max, bounds, the lag window ``win``
    (array of the k previous values, oldest first; null for t < k), and flags."""
    s = Window.partitionBy("series_id")
    o = s.orderBy("period")
    p = (series.withColumn("t", (F.row_number().over(o) - 1).cast("int"))
         .withColumn("n", F.count(F.lit(1)).over(s).cast("int"))
         .withColumn("ymin", F.min("y").over(s))
         .withColumn("ymax", F.max("y").over(s))
         .withColumn("ymean", F.avg("y").over(s))
         .withColumn("last_period", F.max("period").over(s))
         .where(F.col("n") >= MIN_POINTS))
    p = (p.withColumn("k", lag_length(F.col("n")))
         .withColumn("m", F.col("n") - F.col("k"))
         .withColumn("split", F.greatest(F.lit(1), F.least(F.floor(F.col("m") * F.lit(0.8)), F.col("m") - 2)).cast("int"))
         .withColumn("lo", F.lit(0.3) * F.col("ymin"))
         .withColumn("hi", F.lit(2.5) * F.col("ymax")))
    # what training may see: the values up to the last training target
    seen = F.when(F.col("t") < F.col("k") + F.col("split"), F.col("y"))
    p = p.withColumn("tmin", F.min(seen).over(s)).withColumn("tmax", F.max(seen).over(s))
    prev = F.collect_list("y").over(o.rowsBetween(-MAX_LAGS, -1))
    p = p.withColumn("win", F.when(F.col("t") >= F.col("k"), F.slice(prev, -F.col("k"), F.col("k"))))
    i = F.col("t") - F.col("k")
    return (p.withColumn("i", F.when(F.col("t") >= F.col("k"), i))
            .withColumn("is_train", F.col("i") < F.col("split"))
            .withColumn("is_test", F.col("i") >= F.col("split")))


def scaled(c, lo="ymin", hi="ymax"):
    """min-max scaling; a constant series maps to 0."""
    rng = F.col(hi) - F.col(lo)
    return F.when(rng > 0, (c - F.col(lo)) / rng).otherwise(F.lit(0.0))


def unscaled(c, lo="ymin", hi="ymax"):
    return F.col(lo) + c * (F.col(hi) - F.col(lo))


def clip(c, lo="lo", hi="hi"):
    """F8: clip into the forecast bounds."""
    return F.least(F.greatest(c, F.col(lo)), F.col(hi))


def series_info(panel: DataFrame) -> DataFrame:
    """One row per eligible series: n, k, windows, train/test sizes, bounds, tail."""
    pts = F.sort_array(F.collect_list(F.struct("t", "y")))
    # slice with a start beyond the array's size is empty: take min(size, MAX_LAGS)
    take = F.least(F.size(pts), F.lit(MAX_LAGS))
    tail = F.slice(pts, -take, take)
    return panel.groupBy("series_id").agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.first("m").alias("windows"),
        F.first("split").alias("train_size"), (F.first("m") - F.first("split")).alias("test_size"),
        F.first("ymin").alias("ymin"), F.first("ymax").alias("ymax"), F.first("ymean").alias("ymean"),
        F.first("tmin").alias("tmin"), F.first("tmax").alias("tmax"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("last_period").alias("last_period"),
        F.transform(tail, lambda x: x.getField("y")).alias("tail"),
        F.max_by("y", "t").alias("last_y"),
        F.max(F.when(F.col("t") == F.col("n") - 2, F.col("y"))).alias("prev_y"))


def rejects(series: DataFrame) -> DataFrame:
    """series with fewer than 4 positive months."""
    return (series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") < MIN_POINTS)
            .select("series_id", "n", F.format_string("Need at least 4 data points, got %d", F.col("n")).alias("reason")))


def future_labels(info: DataFrame, horizon: int) -> DataFrame:
    """(series_id, step, period label 'yyyy-MM') for the horizon months after the last."""
    return info.select("series_id", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.lit(horizon)),
                    lambda i: F.date_format(F.add_months(F.col("last_period"), i), "yyyy-MM")))
        .alias("pos", "period")).select("series_id", (F.col("pos") + 1).alias("step"), "period")
