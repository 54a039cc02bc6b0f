"""Registered queries: A/B statistics (H1-H8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import abtest as A
from postlens.plans.oracle_stats import effect_label, p_two_sided, t_quantile
from postlens.plans.q_core import posts
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, with_

HOUR_GROUP_SQL = ("CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 18 AND 21 "
                  "THEN 'evening_peak' ELSE 'off_peak' END")


def _moments_sql(unions: str) -> str:
    return f""",
u AS ({unions}),
mom AS (SELECT variable, value, count(m) AS n, avg(m) AS mean, stddev_samp(m) AS std
        FROM u WHERE value IS NOT NULL AND m IS NOT NULL GROUP BY variable, value)"""


STATS_SQL = f""",
j AS (SELECT t.*, coalesce(a.n, 0) AS n_a, a.mean AS mean_a, a.std AS std_a,
             coalesce(b.n, 0) AS n_b, b.mean AS mean_b, b.std AS std_b
      FROM tests t LEFT JOIN mom a ON a.variable = t.variable AND a.value = t.group_a
                   LEFT JOIN mom b ON b.variable = t.variable AND b.value = t.group_b),
s1 AS (SELECT *, (mean_a - mean_b) / sqrt(std_a * std_a / n_a + std_b * std_b / n_b) AS t_stat,
              pow(std_a * std_a / n_a + std_b * std_b / n_b, 2) /
                (pow(std_a * std_a / n_a, 2) / (n_a - 1) + pow(std_b * std_b / n_b, 2) / (n_b - 1)) AS dof,
              sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2)) AS pooled
       FROM j WHERE n_a >= 5 AND n_b >= 5),
s AS (SELECT *, {p_two_sided('t_stat', 'dof')} AS p_value,
             CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END AS cohens_d,
             abs(mean_a - mean_b) / greatest(least(mean_a, mean_b), 1e-9) * 100 AS lift_pct,
             CASE WHEN mean_a > mean_b THEN group_a ELSE group_b END AS winner
      FROM s1)"""

BATTERY_TESTS = """,
tests(test_no, variable, group_a, group_b) AS (VALUES
  (0, 'media_type', 'reel', 'image'), (1, 'media_type', 'reel', 'carousel'),
  (2, 'media_type', 'image', 'carousel'), (3, 'has_call_to_action', '1', '0'),
  (4, '_hour_group', 'morning_peak', 'evening_peak'), (5, '_hour_group', 'morning_peak', 'off_peak'))"""

BATTERY_UNIONS = f"""
  SELECT 'media_type' AS variable, media_type AS value, engagement_rate AS m FROM posts
  UNION ALL SELECT 'has_call_to_action', CAST(has_call_to_action AS VARCHAR), engagement_rate FROM posts
  UNION ALL SELECT '_hour_group', {HOUR_GROUP_SQL}, engagement_rate FROM posts"""


@register("ab_battery", with_(POSTS_CTE + _moments_sql(BATTERY_UNIONS) + BATTERY_TESTS + STATS_SQL, f"""
SELECT CAST(test_no AS BIGINT) AS test_no, variable || ': ' || group_a || ' vs ' || group_b AS test, winner,
       round(lift_pct, 1) AS lift_pct, round(p_value, 4) AS p_value,
       CASE WHEN p_value < 0.05 THEN '✅ Yes' ELSE '❌ No' END AS significant,
       {effect_label('cohens_d')} AS effect_size, round(cohens_d, 3) AS cohens_d, n_a, n_b
FROM s"""))
def q_ab_battery(spark, d):
    """H7: predefined test battery in one scan."""
    return A.ab_battery(posts(spark, d))


def _report_sql(variable: str, pairs: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({i}, '{variable}', '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    unions = f"SELECT '{variable}' AS variable, CAST({variable} AS VARCHAR) AS value, engagement_rate AS m FROM posts"
    tests = f""",
tests(test_no, variable, group_a, group_b) AS (VALUES {values})"""
    body = f""",
ci AS (SELECT *, {t_quantile(0.975, 'n_a - 1').replace(' AS bis)', ') AS bis_a')},
                 {t_quantile(0.975, 'n_b - 1').replace(' AS bis)', ') AS bis_b')} FROM s)
SELECT CAST(test_no AS BIGINT) AS test_no, variable, group_a, group_b, 'engagement_rate' AS metric, n_a, n_b,
       round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b,
       round(mean_a - std_a / sqrt(n_a) * (bis_a.lo + bis_a.hi) / 2, 6) AS ci_a_lo,
       round(mean_a + std_a / sqrt(n_a) * (bis_a.lo + bis_a.hi) / 2, 6) AS ci_a_hi,
       round(mean_b - std_b / sqrt(n_b) * (bis_b.lo + bis_b.hi) / 2, 6) AS ci_b_lo,
       round(mean_b + std_b / sqrt(n_b) * (bis_b.lo + bis_b.hi) / 2, 6) AS ci_b_hi,
       round(t_stat, 6) AS t_stat, round(dof, 6) AS dof, round(p_value, 6) AS p_value,
       round(cohens_d, 6) AS cohens_d, {effect_label('cohens_d')} AS effect_label,
       round(lift_pct, 6) AS lift_pct, 0.05 AS alpha, winner,
       CASE WHEN p_value < 0.05 THEN
         printf('✅ Statistically significant (p=%.4f < α=0.05). **%s** outperforms %s by %.1f%% with a %s effect size.',
                p_value, winner, CASE WHEN mean_a > mean_b THEN group_b ELSE group_a END, lift_pct,
                lower({effect_label('cohens_d')}))
       ELSE printf('❌ Not statistically significant (p=%.4f ≥ α=0.05). The %.1f%% difference between %s and %s could be due to chance — collect more data.',
                p_value, lift_pct, group_a, group_b) END AS interpretation,
       p_value < 0.05 AS significant, CAST(NULL AS VARCHAR) AS error
FROM ci
UNION ALL
SELECT CAST(test_no AS BIGINT), variable, group_a, group_b, 'engagement_rate', n_a, n_b,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       NULL, false,
       printf('Insufficient data: Group A n=%d, Group B n=%d. Need ≥5 each.', n_a, n_b)
FROM j WHERE n_a < 5 OR n_b < 5"""
    return with_(POSTS_CTE + _moments_sql(unions) + tests + STATS_SQL, body)


AB_PAIRS = [("ECONOMY", "STANDARD"), ("PROMO", "LARGE"), ("SMALL", "MEDIUM"),
            ("STANDARD", "PROMO"), ("STANDARD", "NO SUCH CATEGORY")]


@register("ab_test", _report_sql("media_type", [("reel", "image")]))
def q_ab_test(spark, d):
    """H1-H6: one Welch test with effect size, CIs and interpretation."""
    return A.ab_test(posts(spark, d), variable="media_type", a="reel", b="image").withColumn(
        "test_no", F.lit(0))


@register("ab_pairs", _report_sql("content_category", AB_PAIRS))
def q_ab_pairs(spark, d):
    """H8: chosen pairs of one variable in one scan."""
    return A.ab_pairs(posts(spark, d), variable="content_category", pairs=AB_PAIRS)


_ALL_UNIONS = " UNION ALL ".join(
    f"SELECT '{v}|{m}' AS variable, CAST({v} AS VARCHAR) AS value, CAST({m} AS DOUBLE) AS m FROM posts"
    for v in A.ALL_VARIABLES for m in A.ALL_METRICS)
_ALL_TESTS = """,
tests AS (SELECT a.variable, a.value AS group_a, b.value AS group_b
          FROM mom a JOIN mom b ON a.variable = b.variable AND a.value < b.value)"""


@register("ab_all_pairs", with_(POSTS_CTE + _moments_sql(_ALL_UNIONS) + _ALL_TESTS + STATS_SQL, f"""
SELECT split_part(variable, '|', 1) AS variable, split_part(variable, '|', 2) AS metric, group_a, group_b, n_a, n_b,
       round(t_stat, 6) AS t_stat, round(dof, 4) AS dof, round(p_value, 6) AS p_value, round(cohens_d, 6) AS cohens_d,
       {effect_label('cohens_d')} AS effect_label, round(lift_pct, 4) AS lift_pct, winner, p_value < 0.05 AS significant
FROM s
UNION ALL
SELECT split_part(variable, '|', 1), split_part(variable, '|', 2), group_a, group_b, n_a, n_b,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, false
FROM j WHERE n_a < 5 OR n_b < 5"""))
def q_ab_all_pairs(spark, d):
    """H8: every pair of values of five variables, for four metrics."""
    r = A.ab_all_pairs(posts(spark, d))
    return r.select("variable", "metric", "group_a", "group_b", "n_a", "n_b",
                    *[F.round(c, n).alias(c) for c, n in (("t_stat", 6), ("dof", 4), ("p_value", 6), ("cohens_d", 6))],
                    "effect_label", F.round("lift_pct", 4).alias("lift_pct"), "winner", "significant")
