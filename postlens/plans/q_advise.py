"""Registered queries: recommendations (L1-L4, F5) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import advise as L
from postlens.operators import combine as J
from postlens.operators import orderstats as O
from postlens.plans.q_core import posts
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, with_

RANKED = POSTS_CTE + """,
rh AS (SELECT value, r - 1 AS pos, n FROM (
         SELECT hour AS value, count(engagement_rate) AS n,
                row_number() OVER (ORDER BY avg(engagement_rate) DESC, hour) AS r
         FROM posts WHERE hour IS NOT NULL GROUP BY hour HAVING count(engagement_rate) >= 5) WHERE r <= 3),
rc AS (SELECT value, r - 1 AS pos, n FROM (
         SELECT content_category AS value, count(engagement_rate) AS n,
                row_number() OVER (ORDER BY avg(engagement_rate) DESC, content_category) AS r
         FROM posts WHERE content_category IS NOT NULL GROUP BY content_category
         HAVING count(engagement_rate) >= 5) WHERE r <= 3),
rm AS (SELECT value, r - 1 AS pos, n FROM (
         SELECT media_type AS value, count(engagement_rate) AS n,
                row_number() OVER (ORDER BY avg(engagement_rate) DESC, media_type) AS r
         FROM posts WHERE media_type IS NOT NULL GROUP BY media_type
         HAVING count(engagement_rate) >= 5) WHERE r <= 3),
oh AS (SELECT coalesce((SELECT hashtags_count FROM posts WHERE hashtags_count IS NOT NULL
                        GROUP BY hashtags_count ORDER BY avg(engagement_rate) DESC, hashtags_count LIMIT 1),
                       7) AS optimal_hashtags),
bc AS (SELECT coalesce((SELECT has_call_to_action FROM posts WHERE has_call_to_action IS NOT NULL
                        GROUP BY has_call_to_action
                        ORDER BY round(avg(engagement_rate), 5) DESC, has_call_to_action LIMIT 1), 1) AS best_cta),
g AS (SELECT avg(engagement_rate) AS gm FROM posts),
ev AS (SELECT content_category AS cat, media_type AS media, avg(engagement_rate) AS cm, count(*) AS cn
       FROM posts WHERE content_category IS NOT NULL AND media_type IS NOT NULL GROUP BY ALL)"""

CLOCK = ("CAST(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS VARCHAR) || ':00 ' || "
         "CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END")
CONF = "CAST(floor(least(100, least(50, {n}) + least(50, {p} * 100))) AS BIGINT)"


@register("factor_scores", with_(RANKED, """
SELECT coalesce((SELECT value FROM rh WHERE pos = 0), 9) AS best_hour,
       coalesce((SELECT value FROM rc WHERE pos = 0), 'Fitness') AS best_category,
       coalesce((SELECT value FROM rm WHERE pos = 0), 'reel') AS best_media,
       CAST((SELECT optimal_hashtags FROM oh) AS BIGINT) AS optimal_hashtags,
       CAST((SELECT best_cta FROM bc) AS BIGINT) AS best_cta,
       coalesce((SELECT list(value ORDER BY pos) FROM rc), []) AS top_categories,
       coalesce((SELECT list(value ORDER BY pos) FROM rh), []) AS top_hours,
       coalesce((SELECT list(value ORDER BY pos) FROM rm), []) AS top_media"""))
def q_factor_scores(spark, d):
    """L1: best factors and top-3 lists."""
    return L.factor_scores(posts(spark, d)).withColumn(
        "top_hours", F.col("top_hours").cast("array<bigint>"))


@register("content_calendar", with_(RANKED, """,
k AS (SELECT (SELECT count(*) FROM rc) AS kc, (SELECT count(*) FROM rm) AS km, (SELECT count(*) FROM rh) AS kh),
c AS (SELECT i, coalesce(rc.value, 'Fitness') AS cat, coalesce(rm.value, 'reel') AS media,
             coalesce(rh.value, 9) AS hour
      FROM range(0, 7) d(i) CROSS JOIN k
      LEFT JOIN rc ON rc.pos = i % greatest(kc, 1)
      LEFT JOIN rm ON rm.pos = i % greatest(km, 1)
      LEFT JOIN rh ON rh.pos = i % greatest(kh, 1)),
p AS (SELECT c.*, CASE WHEN coalesce(cn, 0) >= 5 THEN cm ELSE gm END AS pred, coalesce(cn, 0) AS n_obs
      FROM c LEFT JOIN ev ON ev.cat = c.cat AND ev.media = c.media CROSS JOIN g)
SELECT ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][i % 7 + 1] AS day,
       cat AS content_category, upper(left(media, 1)) || lower(substr(media, 2)) AS media_type_label,
       """ + CLOCK + """ AS post_time, '#' || CAST((SELECT optimal_hashtags FROM oh) AS VARCHAR) AS hashtags,
       CASE WHEN (SELECT best_cta FROM bc) = 1 THEN '✅ Yes' ELSE '❌ No' END AS cta,
       printf('%.2f%%', pred * 100) AS predicted_engagement,
       """ + CONF.format(n="n_obs", p="pred") + """ AS confidence, round(pred, 6) AS pred_raw,
       CAST(hour AS BIGINT) AS hour, CAST(i AS BIGINT) AS i
FROM p"""))
def q_content_calendar(spark, d):
    """L3 + F5 + L2 + B15: seven-day content calendar."""
    return L.content_calendar(posts(spark, d))


@register("top_strategies", with_(RANKED, """,
pl AS (SELECT rc.pos + 1 AS rank, rc.value AS cat, coalesce(rm.value, (SELECT value FROM rm WHERE pos = 0)) AS media,
              coalesce(rh.value, (SELECT value FROM rh WHERE pos = 0)) AS hour, rc.n AS n_obs
       FROM rc LEFT JOIN rm ON rm.pos = rc.pos LEFT JOIN rh ON rh.pos = rc.pos
       WHERE EXISTS (SELECT 1 FROM rm) AND EXISTS (SELECT 1 FROM rh)),
p AS (SELECT pl.*, CASE WHEN coalesce(cn, 0) >= 5 THEN cm ELSE gm END AS pred
      FROM pl LEFT JOIN ev ON ev.cat = pl.cat AND ev.media = pl.media CROSS JOIN g)
SELECT CAST(rank AS BIGINT) AS rank, cat AS category, media, """ + CLOCK + """ AS hour,
       CAST((SELECT optimal_hashtags FROM oh) AS BIGINT) AS hashtags, CAST((SELECT best_cta FROM bc) AS BIGINT) AS cta,
       round(pred, 6) AS pred_engagement, """ + CONF.format(n="n_obs", p="pred") + """ AS confidence, n_obs
FROM p"""))
def q_top_strategies(spark, d):
    """L4: top strategies."""
    return L.top_strategies(posts(spark, d))


@register("combo_evidence", with_(POSTS_CTE, """
SELECT content_category, media_type, round(avg(engagement_rate), 6) AS combo_mean, count(*) AS combo_n
FROM posts WHERE content_category IS NOT NULL AND media_type IS NOT NULL GROUP BY ALL"""))
def q_combo_evidence(spark, d):
    """evidence per (category, media)."""
    return L.combo_evidence(posts(spark, d))


# ---------------------------------------------------------------- F: sets
@register("new_only", with_(POSTS_CTE, """
SELECT post_id FROM posts n WHERE media_type = 'reel'
  AND NOT EXISTS (SELECT 1 FROM posts e WHERE e.post_datetime < TIMESTAMP '1998-01-01'
                  AND e.post_id IS NOT DISTINCT FROM n.post_id)"""))
def q_new_only(spark, d):
    """new rows whose key is not in the existing set."""
    p = posts(spark, d)
    new = p.where(F.col("media_type") == "reel").select("post_id")
    existing = p.where(F.col("post_datetime") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return J.new_only(new, existing, key="post_id")


@register("stack_union", with_(POSTS_CTE, """
SELECT post_id, likes, round(engagement_rate, 6) AS engagement_rate, NULL::BIGINT AS shares FROM posts WHERE year < 1998
UNION ALL
SELECT post_id, NULL, NULL, shares FROM posts WHERE year >= 1998"""))
def q_stack_union(spark, d):
    """union by name with missing columns."""
    p = posts(spark, d)
    return J.stack_union(p.where(F.col("year") < 1998).select("post_id", "likes", "engagement_rate"),
                         p.where(F.col("year") >= 1998).select("post_id", "shares"))


@register("shared_columns_union", with_(POSTS_CTE, """,
base AS (SELECT post_id, likes, engagement_rate FROM posts WHERE media_type <> 'reel'),
pool AS (SELECT post_id, likes, CASE WHEN saves % 7 = 0 THEN NULL ELSE engagement_rate END AS engagement_rate
         FROM posts WHERE media_type = 'reel'),
kept AS (SELECT * FROM pool WHERE engagement_rate IS NOT NULL)
SELECT post_id, likes, round(engagement_rate, 6) AS engagement_rate,
       (SELECT count(*) FROM kept) AS n_augmented
FROM (SELECT * FROM base UNION ALL SELECT * FROM kept)"""))
def q_shared_columns_union(spark, d):
    """pool rows restricted to shared columns, labelled only, unioned."""
    p = posts(spark, d)
    base = p.where(F.col("media_type") != "reel").select("post_id", "likes", "engagement_rate")
    pool = p.where(F.col("media_type") == "reel").select(
        "post_id", "likes", F.col("impressions").alias("views"),
        F.when(F.col("saves") % 7 == 0, F.lit(None)).otherwise(F.col("engagement_rate"))
         .alias("engagement_rate"))
    combined, n_aug = J.shared_columns_union(base, pool)
    return combined.withColumn("n_augmented", n_aug.scalar())


@register("dedup_links", with_(POSTS_CTE, """
SELECT link, post_id, seen_at FROM (
  SELECT 'https://example.invalid/p/' || CAST(account_id AS VARCHAR) || '-' || content_category AS link,
         post_id, post_datetime AS seen_at,
         row_number() OVER (PARTITION BY account_id, content_category ORDER BY post_datetime, post_id) AS r
  FROM posts) WHERE r = 1"""))
def q_dedup_links(spark, d):
    """first-seen row per link."""
    p = posts(spark, d).select(
        F.concat(F.lit("https://example.invalid/p/"), F.col("account_id").cast("string"), F.lit("-"),
                 F.col("content_category")).alias("link"),
        "post_id", F.col("post_datetime").alias("seen_at"))
    return J.dedup_links(p, order=["seen_at", "post_id"])


@register("scored_lookup", with_(POSTS_CTE, """
SELECT post_id, engagement_rate >= (SELECT median(engagement_rate) FROM posts) AS above_median FROM posts"""))
def q_scored_lookup(spark, d):
    """one-row scalar (median) attached to every row."""
    p = posts(spark, d)
    med = O.exact_quantiles(p, "engagement_rate", [0.5], names=["med"])
    return J.scored_lookup(p, med).select(
        "post_id", (F.col("engagement_rate") >= F.col("med")).alias("above_median"))
