"""Time series (I1-I4): weekly series, linear trends, velocities, forecasts.

All categories are handled by one job: weekly means are a grouped aggregate,
positions come from ``row_number`` partitioned by category (each partition is
a category's aggregated weeks), and the least-squares fit uses the built-in
``regr_*`` aggregates.  No per-category collect or loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import columns as C

METRIC = "engagement_rate"

# Velocity labels (lower bound in %/week, label).
VELOCITY_LABELS = ((2.0, "🚀 Rising"), (0.5, "📈 Growing"), (-0.5, "➡️ Stable"), (-2.0, "📉 Declining"))
VELOCITY_BOTTOM = "⚠️ Falling"
BAND_Z = 1.96


def weekly_series(df: DataFrame, *, cat: str = "content_category", metric: str = METRIC,
                  year: str = "year", week: str = "week") -> DataFrame:
    """I1 + G2 + B13: mean metric per category-week, with position x = 0..n-1."""
    agg = (df.where(F.col(cat).isNotNull() & F.col(year).isNotNull() & F.col(week).isNotNull())
           .groupBy(cat, year, week).agg(F.avg(metric).alias("y")))
    w = Window.partitionBy(cat).orderBy(year, week)
    return (agg.withColumn("x", F.row_number().over(w) - 1)
            .withColumn("week_key", C.week_key(year, week)))


def week_ordinals(df: DataFrame, *, year: str = "year", week: str = "week") -> DataFrame:
    """global ordinal of every distinct (year, week), for ``x="ordinal"``."""
    weeks = df.select(year, week).where(F.col(year).isNotNull() & F.col(week).isNotNull()).distinct()
    # distinct weeks are few (52 per year): one ordered window over them is cheap
    return weeks.withColumn("week_rank", F.dense_rank().over(Window.orderBy(year, week)) - 1)


def _fit(series: DataFrame, cat: str, x: str = "x") -> DataFrame:
    """Per category n, mean, slope, intercept, r2 (reference rules for n<3 and
    constant series)."""
    g = series.groupBy(cat).agg(
        F.count("y").alias("n_weeks"), F.avg("y").alias("mean_y"),
        F.regr_slope("y", x).alias("_slope"), F.regr_intercept("y", x).alias("_icpt"),
        F.regr_r2("y", x).alias("_r2"), F.var_pop("y").alias("_var"))
    small = F.col("n_weeks") < 3
    return g.select(
        cat, "n_weeks", "mean_y",
        F.when(small, F.lit(0.0)).otherwise(F.col("_slope")).alias("slope"),
        F.when(small, F.lit(None).cast("double")).otherwise(F.col("_icpt")).alias("intercept"),
        F.when(small | (F.col("_var") <= 0), F.lit(0.0)).otherwise(F.col("_r2")).alias("r2"))


def trend_velocity(df: DataFrame, *, cat: str = "content_category", metric: str = METRIC,
                   x: str = "position") -> DataFrame:
    """Slope / mean × 100 per category, labelled.

    ``x="position"`` regresses on 0..n-1 (weeks without posts are squeezed out,
    as in the reference); ``x="ordinal"`` uses the global week ordinal.
    """
    s = weekly_series(df, cat=cat, metric=metric)
    if x == "ordinal":
        s = s.join(F.broadcast(week_ordinals(df)), ["year", "week"]).withColumn("x", F.col("week_rank"))
    fit = _fit(s, cat)
    mean = F.when(F.col("mean_y") > 0, F.col("mean_y")).otherwise(F.lit(1.0))
    vel = F.col("slope") / mean * 100
    label = None
    for lo, lab in VELOCITY_LABELS:
        label = F.when(vel >= lo, lab) if label is None else label.when(vel >= lo, lab)
    label = label.otherwise(VELOCITY_BOTTOM)
    return fit.select(cat, "n_weeks", F.col("mean_y").alias("avg_engagement"), "slope",
                      F.round(vel, 2).alias("velocity_pct"), F.round("r2", 3).alias("r2"),
                      label.alias("trend_label"))


def _iso_monday(year, week):
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7)


def forecast(df: DataFrame, *, cat: str = "content_category", metric: str = METRIC,
             history: int = 12, horizon: int = 14, anchor: str = "calendar",
             only: str | None = None) -> DataFrame:
    """I4: per category, fit the last ``history`` weeks and project ``horizon`` days.

    Rows: historical points (actual, fitted, ±1.96·population sd band) and
    forecast points at x = last + j/7, floored at 0, rounded to 5 places.
    Categories with fewer than 3 weeks give no rows.  ``anchor="legacy"``
    dates every row from the last week's Monday (the reference's dating);
    ``"calendar"`` dates history at its own Monday and forecasts j days after
    the last Monday.  ``only`` restricts to one category; an unknown category
    means all rows, labelled ``ALL``.
    """
    src = df
    if only is not None:
        hit = df.where(F.col(cat) == only)
        known = hit.limit(1).count() > 0          # one-row existence probe
        src = hit if known else df.withColumn(cat, F.lit("ALL"))
    # the weekly series feeds the fit, the residual band and the tail: one fact
    # pass, written once (one row per category-week)
    from postlens.operators.orderstats import materialized
    s = materialized(weekly_series(src, cat=cat, metric=metric))
    w_desc = Window.partitionBy(cat).orderBy(F.col("year").desc(), F.col("week").desc())
    last = (s.withColumn("_k", F.row_number().over(w_desc)).where(F.col("_k") <= history)
            .drop("x", "_k"))
    w_pos = Window.partitionBy(cat).orderBy("year", "week")
    last = last.withColumn("x", F.row_number().over(w_pos) - 1)
    fit = _fit(last, cat).where(F.col("n_weeks") >= 3)
    hist = last.join(fit, cat).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x"))
    w_cat = Window.partitionBy(cat)
    hist = hist.withColumn("sd", F.stddev_pop(F.col("y") - F.col("fitted")).over(w_cat))
    hist = hist.withColumn("last_x", F.max("x").over(w_cat))
    hist = hist.withColumn("last_monday", F.max_by(_iso_monday(F.col("year"), F.col("week")),
                                                   F.col("x")).over(w_cat))
    hist = hist.withColumn("own_monday", _iso_monday(F.col("year"), F.col("week")))
    legacy = anchor == "legacy"
    h_rows = hist.select(
        cat,
        (F.date_add("last_monday", (F.col("x") * 7).cast("int")) if legacy else F.col("own_monday")).alias("date"),
        F.col("y").alias("actual"), F.col("fitted").alias("forecast"),
        (F.col("fitted") - BAND_Z * F.col("sd")).alias("lower_ci"),
        (F.col("fitted") + BAND_Z * F.col("sd")).alias("upper_ci"),
        F.lit("historical").alias("type"))
    tail = hist.where(F.col("x") == F.col("last_x")).select(
        cat, "fitted", "slope", "sd", "last_x", "last_monday", "n_weeks")
    j = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("j")
    f = tail.select("*", j).withColumn(
        "fv", F.greatest(F.lit(0.0), F.col("fitted") + F.col("slope") * (F.col("j") / 7.0)))
    f_rows = f.select(
        cat,
        (F.date_add("last_monday", (F.col("n_weeks") * 7 + F.col("j") - 1).cast("int")) if legacy
         else F.date_add("last_monday", F.col("j"))).alias("date"),
        F.lit(None).cast("double").alias("actual"),
        F.round("fv", 5).alias("forecast"),
        F.round(F.greatest(F.lit(0.0), F.col("fv") - BAND_Z * F.col("sd")), 5).alias("lower_ci"),
        F.round(F.col("fv") + BAND_Z * F.col("sd"), 5).alias("upper_ci"),
        F.lit("forecast").alias("type"))
    return h_rows.unionByName(f_rows)
