"""Registered queries: time series."""

from __future__ import annotations

from postlens.operators import explore as X
from postlens.operators import trend as T
from postlens.plans.q_core import posts
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, with_

WEEKLY = POSTS_CTE + """,
w AS (SELECT content_category, year, week, avg(engagement_rate) AS y FROM posts
      WHERE content_category IS NOT NULL AND year IS NOT NULL AND week IS NOT NULL
      GROUP BY content_category, year, week)"""

VELOCITY = WEEKLY + """,
x AS (SELECT *, row_number() OVER (PARTITION BY content_category ORDER BY year, week) - 1 AS x FROM w),
f AS (SELECT content_category, count(y) AS n_weeks, avg(y) AS mean_y,
             CASE WHEN count(y) < 3 THEN 0 ELSE regr_slope(y, x) END AS slope,
             CASE WHEN count(y) < 3 OR var_pop(y) <= 0 THEN 0 ELSE regr_r2(y, x) END AS r2
      FROM x GROUP BY content_category),
v AS (SELECT *, slope / CASE WHEN mean_y > 0 THEN mean_y ELSE 1 END * 100 AS vel FROM f)"""

LABEL = """CASE WHEN vel >= 2 THEN '🚀 Rising' WHEN vel >= 0.5 THEN '📈 Growing' WHEN vel >= -0.5 THEN '➡️ Stable'
            WHEN vel >= -2 THEN '📉 Declining' ELSE '⚠️ Falling' END"""


@register("weekly_series", with_(WEEKLY, """
SELECT content_category, year, week, round(y, 6) AS y,
       row_number() OVER (PARTITION BY content_category ORDER BY year, week) - 1 AS x,
       CAST(year AS VARCHAR) || '-W' || lpad(CAST(week AS VARCHAR), 2, '0') AS week_key
FROM w"""))
def q_weekly_series(spark, d):
    """I1 + G2 + B13: weekly mean per category with positions."""
    return T.weekly_series(posts(spark, d))


@register("week_ordinals", with_(POSTS_CTE, """
SELECT year, week, dense_rank() OVER (ORDER BY year, week) - 1 AS week_rank
FROM (SELECT DISTINCT year, week FROM posts WHERE year IS NOT NULL AND week IS NOT NULL)"""))
def q_week_ordinals(spark, d):
    """global week ordinals."""
    return T.week_ordinals(posts(spark, d))


@register("trend_velocity", with_(VELOCITY, f"""
SELECT content_category, n_weeks, round(mean_y, 6) AS avg_engagement, round(slope, 6) AS slope,
       round(vel, 2) AS velocity_pct, round(r2, 3) AS r2, {LABEL} AS trend_label
FROM v"""))
def q_trend_velocity(spark, d):
    """I2 + I3: per-category trend velocity."""
    return T.trend_velocity(posts(spark, d))


@register("trend_predicates", with_(VELOCITY, """,
r AS (SELECT round(vel, 2) AS velocity_pct FROM v)
SELECT count(*) FILTER (WHERE velocity_pct > 0.5) AS rising_cnt,
       count(*) FILTER (WHERE velocity_pct < -0.5) AS declining_cnt FROM r"""))
def q_trend_predicates(spark, d):
    """Rising / declining topic counts."""
    return X.trend_predicates(T.trend_velocity(posts(spark, d)))


@register("rising_topics", with_(VELOCITY, """
SELECT content_category, round(vel, 2) AS velocity_pct FROM v WHERE round(vel, 2) > 0
ORDER BY round(vel, 2) DESC, content_category LIMIT 4"""))
def q_rising_topics(spark, d):
    """First four rising topics."""
    return X.rising_topics(T.trend_velocity(posts(spark, d))).select("content_category", "velocity_pct")


FORECAST = WEEKLY + """,
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_category
                                                  ORDER BY year DESC, week DESC) AS k FROM w) WHERE k <= 12),
p AS (SELECT *, row_number() OVER (PARTITION BY content_category ORDER BY year, week) - 1 AS x FROM l),
f AS (SELECT content_category, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS b,
             max(x) AS last_x FROM p GROUP BY content_category HAVING count(*) >= 3),
h AS (SELECT p.*, f.s, f.n, f.last_x, f.b + f.s * p.x AS fitted,
             CAST(date_trunc('week', make_date(CAST(year AS INTEGER), 1, 4))
                  + to_days(CAST(7 * (week - 1) AS INTEGER)) AS DATE) AS own_monday
      FROM p JOIN f USING (content_category)),
h2 AS (SELECT *, stddev_pop(y - fitted) OVER (PARTITION BY content_category) AS sd FROM h),
lm AS (SELECT content_category, own_monday AS last_monday, fitted AS last_fit, s, sd, n FROM h2 WHERE x = last_x),
fc AS (SELECT content_category, last_monday, n, j, sd, greatest(0, last_fit + s * j / 7.0) AS fv
       FROM lm CROSS JOIN range(1, 15) t(j))"""


def _forecast_sql(legacy: bool) -> str:
    hdate = ("CAST(max(own_monday) OVER (PARTITION BY content_category) + to_days(CAST(x * 7 AS INTEGER)) AS DATE)"
             if legacy else "own_monday")
    fdate = ("CAST(last_monday + to_days(CAST(n * 7 + j - 1 AS INTEGER)) AS DATE)" if legacy
             else "CAST(last_monday + to_days(CAST(j AS INTEGER)) AS DATE)")
    return with_(FORECAST, f"""
SELECT content_category, {hdate} AS date, round(y, 6) AS actual, round(fitted, 6) AS forecast,
       round(fitted - 1.96 * sd, 6) AS lower_ci, round(fitted + 1.96 * sd, 6) AS upper_ci,
       'historical' AS type FROM h2
UNION ALL
SELECT content_category, {fdate}, NULL, round(fv, 5), round(greatest(0, fv - 1.96 * sd), 5),
       round(fv + 1.96 * sd, 5), 'forecast' FROM fc""")


@register("forecast", _forecast_sql(False))
def q_forecast(spark, d):
    """I4: 14-day forecast for every category (calendar-true dates)."""
    return T.forecast(posts(spark, d))


@register("forecast_legacy", _forecast_sql(True))
def q_forecast_legacy(spark, d):
    """I4 with the reference's dating of history from the last Monday."""
    return T.forecast(posts(spark, d), anchor="legacy")
