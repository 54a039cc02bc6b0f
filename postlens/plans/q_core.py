"""Registered queries: ingest, enrichment, filters, aggregates, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.operators import enrich as N
from postlens.operators import explore as X
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, TIER_CTE, VC_CTE, VC_TIER_CTE, with_
from postlens.sources.posts import ingest_posts, posts_from_tables


def posts(spark, d):
    return ingest_posts(posts_from_tables(spark, d))


def vc_posts(spark, d, **kw):
    return N.viral_coefficients(posts(spark, d), **kw)


R6 = "round({0}, 6) AS {1}"


def r6(*pairs):
    return ", ".join(R6.format(e, a) for e, a in pairs)


# ---------------------------------------------------------------- wave 0
@register("topic_viral_ranking", with_(VC_CTE, """,
agg AS (
  SELECT content_category, avg(vc_raw) AS avg_vc, avg(saves) AS avg_saves,
         avg(shares) AS avg_shares, avg(likes) AS avg_likes,
         avg(high_value_ratio) AS avg_high_value_ratio, avg(engagement_rate) AS avg_engagement,
         count(post_id) AS n_posts
  FROM vc WHERE content_category IS NOT NULL GROUP BY content_category),
s AS (SELECT *, coalesce(avg_saves / nullif(avg_shares, 0), avg_saves) AS save_to_share_ratio FROM agg)
SELECT content_category, """ + r6(("avg_vc", "avg_vc"), ("avg_saves", "avg_saves"),
                                  ("avg_shares", "avg_shares"), ("avg_likes", "avg_likes"),
                                  ("avg_high_value_ratio", "avg_high_value_ratio"),
                                  ("avg_engagement", "avg_engagement"),
                                  ("save_to_share_ratio", "save_to_share_ratio"),
                                  ("avg_vc * 0.6 + save_to_share_ratio * 0.4", "organic_growth_score")) + """,
       n_posts,
       row_number() OVER (ORDER BY avg_vc * 0.6 + save_to_share_ratio * 0.4 DESC, content_category) AS rank
FROM s"""))
def q_topic_viral_ranking(spark, d):
    """D9 flagship: which topics spread best."""
    return X.topic_viral_ranking(vc_posts(spark, d, percentile=False, tiers=False))


# ---------------------------------------------------------------- wave 1: ingest + enrich
@register("ingest_posts", with_(POSTS_CTE, """
SELECT post_id, hour, day, day_num, month, month_num, week, year, viral_score,
       round(save_to_share, 6) AS save_to_share, engagement_rate IS NOT NULL AS has_metric
FROM posts"""))
def q_ingest_posts(spark, d):
    """A1 + B1-B5 + C4: typed posts with calendar parts and scores."""
    p = posts(spark, d)
    return p.select("post_id", "hour", "day", "day_num", "month", "month_num", "week", "year",
                    "viral_score", "save_to_share",
                    F.col("engagement_rate").isNotNull().alias("has_metric"))


COMPLETE = ("post_id", "content_category", "media_type", "account_type", "post_datetime", "save_to_share",
            "viral_score", "engagement_rate")


@register("complete_posts", with_(POSTS_CTE, f"""
SELECT {", ".join(f"round({c}, 6) AS {c}" if c in ("save_to_share", "engagement_rate") else c for c in COMPLETE)}
FROM posts WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COMPLETE)}"""))
def q_complete_posts(spark, d):
    """C4, any-null form: posts without a null in any column."""
    p = X.require_metric(posts(spark, d).select(*COMPLETE), None)
    return p.withColumns({c: F.round(c, 6) for c in ("save_to_share", "engagement_rate")})


@register("calendar_parts_nb", with_(POSTS_CTE, """
SELECT post_id, hour(post_datetime) AS hour, day(post_datetime) AS day,
       month(post_datetime) AS month FROM posts"""))
def q_calendar_parts_nb(spark, d):
    """Notebook calendar variant."""
    p = posts_from_tables(spark, d).where(F.col("engagement_rate").isNotNull())
    return p.select("post_id", *[v.alias(k) for k, v in C.calendar_parts_nb().items()])


@register("performance_tier", with_(TIER_CTE, "SELECT post_id, tier FROM tiered"))
def q_performance_tier(spark, d):
    """Quartile tiers of the whole table."""
    return N.performance_tiers(posts(spark, d)).select("post_id", "tier")


@register("viral_coefficient", with_(VC_TIER_CTE, """
SELECT post_id, round(vc_raw, 6) AS vc_raw, round(high_value_ratio, 6) AS high_value_ratio,
       round((rank() OVER (ORDER BY vc_raw) - 1 + (count(*) OVER (PARTITION BY vc_raw) + 1) / 2.0)
             / count(vc_raw) OVER () * 100, 6) AS vc_percentile,
       vc_tier
FROM vct"""))
def q_viral_coefficient(spark, d):
    """VC, high-value ratio, average-tie percentile, VC tier."""
    return vc_posts(spark, d).select("post_id", "vc_raw", "high_value_ratio",
                                     "vc_percentile", "vc_tier")


@register("row_score_labels", with_(POSTS_CTE, """
SELECT post_id,
  round((coalesce(saves, 0) * 3 + coalesce(shares, 0) * 2 + coalesce(comments, 0) * 1.5)
        / greatest(coalesce(nullif(reach, 0), 1), 1) * 1000, 4) AS row_vc,
  CASE WHEN engagement_rate >= 0.08 THEN 'VIRAL' WHEN engagement_rate >= 0.05 THEN 'HIGH'
       WHEN engagement_rate >= 0.03 THEN 'MEDIUM' WHEN engagement_rate >= 0.01 THEN 'LOW'
       ELSE 'VERY LOW' END AS band
FROM posts"""))
def q_row_score_labels(spark, d):
    """B11 + B12: scoring-variant VC and fixed engagement bands."""
    return posts(spark, d).select("post_id", C.row_viral_coefficient().alias("row_vc"),
                                  C.engagement_band("engagement_rate").alias("band"))


@register("calendar_labels", with_(POSTS_CTE, """
SELECT post_id, CAST(year AS VARCHAR) || '-W' || lpad(CAST(week AS VARCHAR), 2, '0') AS week_key,
  CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 18 AND 21 THEN 'evening_peak'
       ELSE 'off_peak' END AS hour_group,
  CAST(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS VARCHAR)
    || ':00 ' || CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END AS clock_label,
  lpad(CAST(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS VARCHAR), 2, '0')
    || ':00 ' || CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END AS clock_label_padded
FROM posts"""))
def q_calendar_labels(spark, d):
    """Week key, hour group, 12-hour clock labels."""
    return posts(spark, d).select(
        "post_id", C.week_key().alias("week_key"), C.hour_group().alias("hour_group"),
        C.clock_label().alias("clock_label"), C.clock_label(padded=True).alias("clock_label_padded"))


@register("cap_at_quantile", with_(VC_CTE, """
SELECT post_id, round(least(vc_raw, (SELECT quantile_cont(vc_raw, 0.99) FROM vc)), 6) AS vc_capped
FROM vc"""))
def q_cap_at_quantile(spark, d):
    """VC clipped at its p99."""
    v = vc_posts(spark, d, percentile=False, tiers=False)
    return N.cap_at_quantile(v, col="vc_raw", q=0.99, out="vc_capped").select("post_id", "vc_capped")


@register("present_table", with_(VC_TIER_CTE, """
SELECT post_id AS "Post", content_category AS "Category", media_type AS "Media",
       round(vc_raw, 4) AS "VC", round(engagement_rate, 4) AS "Engagement", vc_tier AS "Tier"
FROM vct ORDER BY vc_raw DESC, post_id LIMIT 500"""))
def q_present_table(spark, d):
    """Display table, 500 rows of an explicit order, rounded and renamed."""
    v = vc_posts(spark, d, percentile=False)
    return N.present_table(
        v, columns=["post_id", "content_category", "media_type", "vc_raw", "engagement_rate",
                    "vc_tier", "no_such_column"],
        order_by=[F.col("vc_raw").desc(), F.col("post_id")],
        rename={"post_id": "Post", "content_category": "Category", "media_type": "Media",
                "vc_raw": "VC", "engagement_rate": "Engagement", "vc_tier": "Tier"})


@register("model_frame", with_(POSTS_CTE, """
SELECT account_type, media_type, content_category, traffic_source, has_call_to_action,
       follower_count, likes, comments, shares, saves, reach, impressions, followers_gained,
       caption_length, hashtags_count, round(engagement_rate, 6) AS engagement_rate,
       hour, day_num, month_num, 'organic' AS label_source
FROM posts"""))
def q_model_frame(spark, d):
    """B18 + B19: defaults for absent columns, non-feature columns dropped."""
    p = N.with_defaults(posts(spark, d), {"label_source": "organic", "likes": -1})
    return N.model_columns(p)


# ---------------------------------------------------------------- wave 1: filters
FILTER_SQL = """
SELECT post_id, content_category, media_type, account_type, follower_count
FROM posts
WHERE content_category IN ('STANDARD', 'ECONOMY', 'PROMO')
  AND media_type IN ('reel', 'carousel') AND account_type IN ('creator', 'brand')
  AND follower_count BETWEEN 5000 AND 60000
  AND CAST(post_datetime AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'"""


@register("facet_filter", with_(POSTS_CTE, FILTER_SQL))
def q_facet_filter(spark, d):
    """Facet IN lists, follower range and inclusive date range (pushed down)."""
    p = X.facet_filter(posts(spark, d),
                       categories=["STANDARD", "ECONOMY", "PROMO"],
                       media=["reel", "carousel"], accounts=["creator", "brand"],
                       followers=(5000, 60000), dates=("1996-03-01", "1999-10-31"))
    return p.select("post_id", "content_category", "media_type", "account_type", "follower_count")


@register("page_filter", with_(POSTS_CTE, """
SELECT post_id FROM posts WHERE media_type = 'image'
  AND CAST(post_datetime AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"""))
def q_page_filter(spark, d):
    """Page-level media filter (not "All") and date range."""
    return X.page_filter(posts(spark, d), media="image",
                         dates=("1997-01-01", "1997-12-31")).select("post_id")


@register("facet_values", with_(POSTS_CTE, """
SELECT DISTINCT 'content_category' AS facet, content_category AS value FROM posts WHERE content_category IS NOT NULL
UNION ALL SELECT DISTINCT 'media_type', media_type FROM posts WHERE media_type IS NOT NULL
UNION ALL SELECT DISTINCT 'account_type', account_type FROM posts WHERE account_type IS NOT NULL"""))
def q_facet_values(spark, d):
    """Distinct non-null facet values (long form)."""
    return X.facet_values(posts(spark, d))


@register("facet_ranges", with_(POSTS_CTE, """
SELECT min(follower_count) AS min_followers, max(follower_count) AS max_followers,
       CAST(min(post_datetime) AS DATE) AS min_date, CAST(max(post_datetime) AS DATE) AS max_date
FROM posts"""))
def q_facet_ranges(spark, d):
    """Follower and date domains."""
    return X.facet_ranges(posts(spark, d))


# ---------------------------------------------------------------- wave 1: aggregates
@register("kpi_summary", with_(POSTS_CTE, """
SELECT count(*) AS total_posts, round(avg(engagement_rate), 6) AS avg_engagement,
       round(avg(likes), 6) AS avg_likes, CAST(sum(reach) AS BIGINT) AS total_reach,
       CAST(sum(impressions) AS BIGINT) AS total_impr, round(avg(viral_score), 6) AS avg_viral
FROM posts"""))
def q_kpi_summary(spark, d):
    """KPI strip."""
    return X.kpi_summary(posts(spark, d))


@register("mean_by_key", with_(POSTS_CTE, """
SELECT hour, round(avg(engagement_rate), 6) AS avg_metric, count(engagement_rate) AS n_posts
FROM posts WHERE hour IS NOT NULL GROUP BY hour"""))
def q_mean_by_key(spark, d):
    """Average metric per hour."""
    return X.mean_by_key(posts(spark, d), keys="hour")


@register("best_key", with_(POSTS_CTE, """,
g AS (
  SELECT 'hour' AS key_name, CAST(hour AS VARCHAR) AS best_value, avg(engagement_rate) AS a,
         hour AS o_num, NULL AS o_str FROM posts WHERE hour IS NOT NULL GROUP BY hour
  UNION ALL SELECT 'content_category', content_category, avg(engagement_rate), NULL, content_category
         FROM posts WHERE content_category IS NOT NULL GROUP BY content_category
  UNION ALL SELECT 'media_type', media_type, avg(engagement_rate), NULL, media_type
         FROM posts WHERE media_type IS NOT NULL GROUP BY media_type
  UNION ALL SELECT 'day', day, avg(engagement_rate), NULL, day
         FROM posts WHERE day IS NOT NULL GROUP BY day)
SELECT key_name, best_value, round(a, 6) AS best_avg FROM (
  SELECT *, row_number() OVER (PARTITION BY key_name ORDER BY a DESC, o_num, o_str) AS r FROM g)
WHERE r = 1"""))
def q_best_key(spark, d):
    """D3: smart insights — best hour, category, media, day in one scan."""
    return X.best_key(posts(spark, d))


@register("monthly_trend", with_(POSTS_CTE, """
SELECT month_num, month, round(avg(engagement_rate), 6) AS avg_metric
FROM posts WHERE month_num IS NOT NULL AND month IS NOT NULL GROUP BY month_num, month"""))
def q_monthly_trend(spark, d):
    """Average metric per month."""
    return X.monthly_trend(posts(spark, d))


@register("weekday_profile", with_(POSTS_CTE, """
SELECT day_num, day, round(avg(engagement_rate), 6) AS avg_metric
FROM posts WHERE day IS NOT NULL GROUP BY day_num, day"""))
def q_weekday_profile(spark, d):
    """Average metric per weekday."""
    return X.weekday_profile(posts(spark, d))


@register("actions_by_media", with_(POSTS_CTE, """
SELECT media_type, round(avg(likes), 6) AS avg_likes, round(avg(shares), 6) AS avg_shares,
       round(avg(saves), 6) AS avg_saves
FROM posts WHERE media_type IS NOT NULL GROUP BY media_type"""))
def q_actions_by_media(spark, d):
    """Average actions per media type."""
    return X.actions_by_media(posts(spark, d))


@register("tier_funnel", with_(TIER_CTE, """,
c AS (SELECT tier, count(*) AS n_posts,
             CASE tier WHEN 'Viral' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS stage
      FROM tiered GROUP BY tier)
SELECT tier, n_posts, stage, round(n_posts * 100.0 / first_value(n_posts) OVER (ORDER BY stage), 6)
       AS pct_of_first FROM c"""))
def q_tier_funnel(spark, d):
    """Tier funnel."""
    return X.tier_funnel(N.performance_tiers(posts(spark, d)))


@register("virality_kpis", with_(VC_TIER_CTE, """,
agg AS (SELECT content_category, avg(vc_raw) AS a, avg(saves) AS sv, avg(shares) AS sh
        FROM vct WHERE content_category IS NOT NULL GROUP BY content_category),
top AS (SELECT content_category AS top_category FROM agg
        ORDER BY a * 0.6 + coalesce(sv / nullif(sh, 0), sv) * 0.4 DESC, content_category LIMIT 1)
SELECT round(avg(vc_raw), 6) AS avg_vc, round(max(vc_raw), 6) AS peak_vc,
       count(*) FILTER (WHERE vc_tier = 'Mega-Viral') AS mega_cnt,
       (SELECT top_category FROM top) AS top_category
FROM vct"""))
def q_virality_kpis(spark, d):
    """Virality KPIs."""
    return X.virality_kpis(vc_posts(spark, d, percentile=False))


@register("action_quality", with_(POSTS_CTE, """,
a AS (SELECT content_category, avg(coalesce(saves, 0) + coalesce(shares, 0)) AS high_value,
             avg(coalesce(likes, 0)) AS passive
      FROM posts WHERE content_category IS NOT NULL GROUP BY content_category)
SELECT content_category, round(high_value, 6) AS high_value, round(passive, 6) AS passive,
       round(high_value / (high_value + passive) * 100, 6) AS high_value_pct FROM a"""))
def q_action_quality(spark, d):
    """Passive vs high-value actions per category."""
    return X.action_quality(posts(spark, d))


@register("cta_impact", with_(POSTS_CTE, """,
a AS (SELECT has_call_to_action, round(avg(engagement_rate), 5) AS avg_metric
      FROM posts WHERE has_call_to_action IS NOT NULL GROUP BY has_call_to_action)
SELECT CAST(has_call_to_action AS BIGINT) AS has_call_to_action, avg_metric,
       row_number() OVER (ORDER BY avg_metric DESC, has_call_to_action) = 1 AS is_best FROM a"""))
def q_cta_impact(spark, d):
    """CTA impact."""
    return X.cta_impact(posts(spark, d))


@register("hashtag_effectiveness", with_(POSTS_CTE, """,
a AS (SELECT hashtags_count, avg(engagement_rate) AS avg_engagement, count(engagement_rate) AS n_posts
      FROM posts WHERE hashtags_count IS NOT NULL GROUP BY hashtags_count HAVING count(engagement_rate) >= 10)
SELECT CAST(hashtags_count AS BIGINT) AS hashtags_count, round(avg_engagement, 6) AS avg_engagement, n_posts,
       row_number() OVER (ORDER BY avg_engagement DESC, hashtags_count) = 1 AS is_optimal FROM a"""))
def q_hashtag_effectiveness(spark, d):
    """Hashtag-count sweet spot."""
    return X.hashtag_effectiveness(posts(spark, d))


@register("optimal_hashtags", with_(POSTS_CTE, """
SELECT coalesce((SELECT hashtags_count FROM posts WHERE hashtags_count IS NOT NULL
                 GROUP BY hashtags_count ORDER BY avg(engagement_rate) DESC, hashtags_count LIMIT 1),
                7)::BIGINT AS optimal_hashtags"""))
def q_optimal_hashtags(spark, d):
    """Best hashtag count (default 7)."""
    return X.optimal_hashtags(posts(spark, d))


@register("value_histogram", with_(VC_CTE, """,
b AS (SELECT min(vc_raw) AS lo, quantile_cont(vc_raw, 0.99) AS cap FROM vc),
x AS (SELECT CASE WHEN cap = lo THEN 1
                  ELSE least(floor((least(vc_raw, cap) - lo) / ((cap - lo) / 60)) + 1, 60) END AS bin,
             lo, cap FROM vc, b)
SELECT CAST(bin AS BIGINT) AS bin, round(lo + (bin - 1) * (cap - lo) / 60, 6) AS bin_lo,
       round(lo + bin * (cap - lo) / 60, 6) AS bin_hi, count(*) AS n_posts
FROM x GROUP BY bin, lo, cap"""))
def q_value_histogram(spark, d):
    """60-bin histogram of VC capped at p99."""
    return X.value_histogram(vc_posts(spark, d, percentile=False, tiers=False))


# ---------------------------------------------------------------- wave 1: top-k
@register("top_posts", with_(VC_CTE, """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY vc_raw DESC, post_id) AS r FROM vc) WHERE r <= 6),
q AS (SELECT quantile_cont(engagement_rate, 0.25) AS q1, quantile_cont(engagement_rate, 0.5) AS q2,
             quantile_cont(engagement_rate, 0.75) AS q3 FROM posts)
SELECT post_id, content_category, media_type, round(vc_raw, 6) AS vc_raw,
       round(engagement_rate, 6) AS engagement_rate, likes, shares, saves,
       CASE WHEN engagement_rate >= q3 THEN 'Viral' WHEN engagement_rate >= q2 THEN 'High'
            WHEN engagement_rate >= q1 THEN 'Medium' ELSE 'Low' END AS tier
FROM t, q"""))
def q_top_posts(spark, d):
    """Six posts with the highest VC (tiers from the whole table)."""
    p = posts(spark, d)
    tiered = N.performance_tiers(p)
    return X.top_posts(N.viral_coefficients(tiered, percentile=False, tiers=False))


@register("best_n", with_(POSTS_CTE, """
SELECT content_category, round(avg_metric, 6) AS avg_metric, n_posts, rank FROM (
  SELECT content_category, avg(engagement_rate) AS avg_metric, count(engagement_rate) AS n_posts,
         row_number() OVER (ORDER BY avg(engagement_rate) DESC, content_category) AS rank
  FROM posts WHERE content_category IS NOT NULL GROUP BY content_category
  HAVING count(engagement_rate) >= 5) WHERE rank <= 3"""))
def q_best_n(spark, d):
    """Top-3 categories with n ≥ 5."""
    return X.best_n(posts(spark, d), key="content_category")


@register("best_days", with_(POSTS_CTE, """
SELECT day, round(avg_metric, 6) AS avg_metric, n_posts, rank FROM (
  SELECT day, avg(engagement_rate) AS avg_metric, count(engagement_rate) AS n_posts,
         row_number() OVER (ORDER BY avg(engagement_rate) DESC, day) AS rank
  FROM posts WHERE day IS NOT NULL GROUP BY day HAVING count(engagement_rate) >= 5) WHERE rank <= 7"""))
def q_best_days(spark, d):
    """Weekdays ranked."""
    return X.best_days(posts(spark, d))


@register("suggested_topics", with_(POSTS_CTE, """,
cat AS (SELECT content_category, avg(engagement_rate) AS a FROM posts
        WHERE content_category IS NOT NULL GROUP BY content_category),
top AS (SELECT *, row_number() OVER (ORDER BY a DESC, content_category) AS rank FROM cat),
bm AS (SELECT content_category, arg_max(media_type, a) AS best_media_type FROM (
         SELECT content_category, media_type, avg(engagement_rate) AS a FROM posts
         WHERE media_type IS NOT NULL GROUP BY ALL) GROUP BY content_category),
bh AS (SELECT content_category, hour AS best_hour FROM (
         SELECT content_category, hour, row_number() OVER (PARTITION BY content_category
                ORDER BY avg(engagement_rate) DESC, hour) AS r
         FROM posts WHERE hour IS NOT NULL GROUP BY content_category, hour) WHERE r = 1)
SELECT top.content_category, round(a, 6) AS avg_engagement, rank, best_media_type, best_hour
FROM top LEFT JOIN bm USING (content_category) LEFT JOIN bh USING (content_category)
WHERE rank <= 4"""))
def q_suggested_topics(spark, d):
    """E5: top-4 topics with best media and hour each."""
    return X.suggested_topics(posts(spark, d))


@register("sample_rows", with_(POSTS_CTE, """
SELECT post_id, content_category, round(engagement_rate, 6) AS engagement_rate FROM posts
ORDER BY md5(post_id || '42'), post_id LIMIT 2000"""))
def q_sample_rows(spark, d):
    """Deterministic 2,000-row sample."""
    return X.sample_rows(posts(spark, d), n=2000).select("post_id", "content_category",
                                                        "engagement_rate")
