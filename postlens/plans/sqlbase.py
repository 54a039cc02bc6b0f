"""Oracle SQL building blocks (DuckDB dialect).

These texts are written independently of the Spark plans: plain SQL over the
posts adapter, window functions and DuckDB's own quantile functions.
"""

from postlens.sources.posts import POSTS_ADAPTER_SQL

POSTS_CTE = f"""
raw AS ({POSTS_ADAPTER_SQL}),
posts AS (
  SELECT *, hour(post_datetime) AS hour, dayname(post_datetime) AS day,
         isodow(post_datetime) - 1 AS day_num, monthname(post_datetime) AS month,
         month(post_datetime) AS month_num, weekofyear(post_datetime) AS week,
         isoyear(post_datetime) AS year,
         likes + 2 * shares + 3 * saves AS viral_score,
         coalesce(saves / nullif(shares, 0), saves) AS save_to_share
  FROM raw WHERE engagement_rate IS NOT NULL)"""

VC_CTE = POSTS_CTE + """,
vc AS (
  SELECT *,
    (coalesce(saves, 0) * 3.0 + coalesce(shares, 0) * 2.0 + coalesce(comments, 0) * 1.5)
      / coalesce(nullif(reach, 0), 1) * 1000 AS vc_raw,
    (coalesce(saves, 0) + coalesce(shares, 0)) * 1.0 /
      CASE WHEN coalesce(saves, 0) + coalesce(shares, 0) + coalesce(likes, 0)
                + coalesce(comments, 0) = 0 THEN 1
           ELSE coalesce(saves, 0) + coalesce(shares, 0) + coalesce(likes, 0)
                + coalesce(comments, 0) END AS high_value_ratio
  FROM posts)"""

VC_TIER_CTE = VC_CTE + """,
vq AS (SELECT quantile_cont(vc_raw, 0.5) AS p50, quantile_cont(vc_raw, 0.8) AS p80,
              quantile_cont(vc_raw, 0.95) AS p95 FROM vc),
vct AS (
  SELECT vc.*, CASE WHEN vc_raw >= p95 THEN 'Mega-Viral' WHEN vc_raw >= p80 THEN 'Viral'
                    WHEN vc_raw >= p50 THEN 'Rising' ELSE 'Low' END AS vc_tier
  FROM vc, vq)"""

TIER_CTE = POSTS_CTE + """,
pq AS (SELECT quantile_cont(engagement_rate, 0.25) AS q1, quantile_cont(engagement_rate, 0.5) AS q2,
              quantile_cont(engagement_rate, 0.75) AS q3 FROM posts),
tiered AS (
  SELECT posts.*, CASE WHEN engagement_rate >= q3 THEN 'Viral' WHEN engagement_rate >= q2 THEN 'High'
                       WHEN engagement_rate >= q1 THEN 'Medium' ELSE 'Low' END AS tier
  FROM posts, pq)"""


def with_(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"
