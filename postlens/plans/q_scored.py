"""Registered queries: what follows a label or a prediction, on given ones (D16, E4, K9, A7,
M5, D18, N2).

The same operators as after a fit, with labels from the tables and a pipeline whose one
stage is a formula; so SQL can state every value."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from postlens.functions import text as TX
from postlens.operators import learn as K
from postlens.operators import scoring as M
from postlens.operators import textops as TO
from postlens.plans import q_text as Q
from postlens.plans.q_core import posts
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, with_
from postlens.session import checkpoint_dir
from postlens.sources import store as S
from postlens.sources.comments import comments_from_tables

# the labels that the tables give: turns by role, documents by their marks
GIVEN_SQL = """given AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS comment_id,
         CASE WHEN role = 'user' THEN 'Relatable' ELSE 'Neutral' END AS label, 0.5e0 AS confidence FROM conversations
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR),
         CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Relatable' ELSE 'Neutral' END, 0.75e0 FROM labels)"""
_TAGGED = f"""{GIVEN_SQL},
tagged AS (
  SELECT c.comment_id, c.content_category, c.comment_text, r.relatability_score, p.vader_compound, g.label, g.confidence
  FROM ({Q.COMMENTS_SQL}) c JOIN given g USING (comment_id)
  JOIN ({Q._rel_sql(Q.PROSE_STRUGGLE, Q.PROSE_PHRASES, Q.PROSE_EMPATHY)}) r USING (comment_id)
  JOIN ({Q._pol_sql(Q.PROSE_LEXICON)}) p USING (comment_id))"""


def _given(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("comment_id"),
        F.when(F.col("role") == "user", "Relatable").otherwise("Neutral").alias("label"), F.lit(0.5).alias("confidence"))
    marks = spark.read.parquet(f"{d}/labels.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("comment_id"),
        F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Relatable").otherwise("Neutral").alias("label"),
        F.lit(0.75).alias("confidence"))
    tagged = TO.tag_comments(comments_from_tables(spark, d), lexicon=Q.PROSE_LEXICON, struggle=Q.PROSE_STRUGGLE,
                             phrases=Q.PROSE_PHRASES, empathy=Q.PROSE_EMPATHY)
    return tagged.join(conv.unionByName(marks), "comment_id")


@register("category_sentiment_given", f"""WITH {_TAGGED},
flag AS (SELECT content_category,
  {", ".join(f"max(CAST(contains(lower(comment_text) || ' ', {Q._q(w)}) AS INTEGER)) AS {t}{i}"
             for t, ws in (("s", TX.AWARENESS_SYSTEMIC), ("h", TX.AWARENESS_SHARED), ("p", TX.AWARENESS_PERSONAL))
             for i, w in enumerate(ws))}
  FROM tagged WHERE content_category IS NOT NULL GROUP BY content_category),
g AS (SELECT content_category, avg(relatability_score) AS ar, avg(vader_compound) AS av, avg(confidence) AS ac,
             100 * avg(CAST(label = 'Relatable' AS INTEGER)) AS pr, 100 * avg(CAST(label = 'Negative' AS INTEGER)) AS pn,
             count(comment_text) AS n FROM tagged WHERE content_category IS NOT NULL GROUP BY content_category)
SELECT content_category, round(ar, 6) AS avg_relatability, round(av, 6) AS avg_vader, round(ac, 6) AS avg_confidence,
       round(pr, 6) AS pct_relatable, round(pn, 6) AS pct_negative, n AS n_comments,
       CASE WHEN {" + ".join(f"s{i}" for i in range(len(TX.AWARENESS_SYSTEMIC)))} >= 2 THEN 'Systemic'
            WHEN {" + ".join(f"h{i}" for i in range(len(TX.AWARENESS_SHARED)))} >= 2 THEN 'Shared'
            WHEN {" + ".join(f"p{i}" for i in range(len(TX.AWARENESS_PERSONAL)))} >= 3 THEN 'Personal'
            ELSE 'None' END AS problem_awareness FROM g JOIN flag USING (content_category)""")
def q_category_sentiment_given(spark, d):
    """D16 on given labels: averages, shares and awareness per category."""
    return TO.category_sentiment(_given(spark, d))


@register("top_comments_given", f"""WITH {_TAGGED}
SELECT comment_id, comment_text, content_category, relatability_score, vader_compound, confidence FROM tagged
WHERE label = 'Relatable' ORDER BY relatability_score DESC, comment_id LIMIT 10""")
def q_top_comments_given(spark, d):
    """E4 on given labels."""
    return TO.top_comments(_given(spark, d))


FORMULA = "1e-3 * hashtags_count + 2e-2 * has_call_to_action + 1e-5 * caption_length - 1e-2"
PREDICTED = f"round(greatest({FORMULA}, 0e0), 6)"
BAND = """CASE WHEN predicted_engagement >= 8e-2 THEN 'VIRAL' WHEN predicted_engagement >= 5e-2 THEN 'HIGH'
            WHEN predicted_engagement >= 3e-2 THEN 'MEDIUM' WHEN predicted_engagement >= 1e-2 THEN 'LOW'
            ELSE 'VERY LOW' END"""


def _model():
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {FORMULA} AS prediction FROM __THIS__")])


@register("batch_predict", with_(POSTS_CTE, f"SELECT post_id, {PREDICTED} AS predicted_engagement FROM posts"))
def q_batch_predict(spark, d):
    """K9 + A7: a pipeline saved, loaded, and applied to the posts (floor 0, 6 places)."""
    path = os.path.join(checkpoint_dir(spark), f"formula-{uuid.uuid4().hex}")
    S.model_store_save(_model(), spark.createDataFrame([(0.0,)], "mae double"), path)
    model, _ = S.model_store_load(spark, path)
    return K.batch_predict(model, posts(spark, d)).select("post_id", "predicted_engagement")


# pages made of posts: likes, comments and a follower count that the post lacks now and then
_PAGES = """,
d AS (SELECT quantile_cont(follower_count, 0.5) AS fc, quantile_cont(likes, 0.5) AS lk, quantile_cont(comments, 0.5) AS cm,
             trunc(quantile_cont(shares, 0.5)) AS sh, trunc(quantile_cont(saves, 0.5)) AS sv FROM posts),
s AS (SELECT post_id AS link, likes, coalesce(comments, 0) AS c, hashtags_count, caption_length,
             CAST(has_call_to_action AS DOUBLE) AS has_call_to_action,
             coalesce(CASE WHEN saves % 3 <> 0 THEN CAST(follower_count AS DOUBLE) END, (SELECT fc FROM d)) AS f,
             CASE WHEN saves % 2 = 0 THEN impressions ELSE 0 END AS views FROM posts),
e AS (SELECT *, CASE WHEN f > 0 THEN least(greatest(likes * 5 + c * 10, likes + c), f) ELSE likes * 5 + c * 10 END AS est FROM s),
r AS (SELECT link, CASE WHEN views > 0 THEN floor(views * 0.6) ELSE est END AS reach,
             CASE WHEN c = 0 THEN (SELECT cm FROM d) ELSE c END AS comments, """ + PREDICTED + """ AS predicted_engagement FROM e),
scored AS (SELECT link, predicted_engagement,
  round(((SELECT sv FROM d) * 3e0 + (SELECT sh FROM d) * 2e0 + comments * 15e-1) / greatest(reach, 1) * 1000, 4) AS viral_coefficient,
  """ + BAND + """ AS engagement_tier FROM r)
"""
_SCORED = ["link", "predicted_engagement", "viral_coefficient", "engagement_tier"]


def _scraped(spark, d):
    return posts(spark, d).select(
        F.col("post_id").alias("link"), "likes", F.col("comments").alias("comments_count"), "hashtags_count",
        "caption_length", F.col("has_call_to_action").cast("double").alias("has_cta"),
        F.when(F.col("saves") % 3 != 0, F.col("follower_count").cast("double")).alias("follower_count"),
        F.when(F.col("saves") % 2 == 0, F.col("impressions")).otherwise(0).alias("views"))


@register("page_fields", with_(POSTS_CTE, """
SELECT post_id, likes, coalesce(comments, 0) AS comments_count, CASE WHEN saves % 2 = 0 THEN impressions END AS views,
       CAST(account_id AS VARCHAR) AS username,
       CASE WHEN saves % 3 = 0 THEN 9 ELSE hour(post_datetime) END AS hour,
       CASE WHEN saves % 3 = 0 THEN 16 ELSE weekofyear(post_datetime) END AS week FROM posts"""))
def q_page_fields(spark, d):
    """J14 + J9 + M6: pages written from the posts (counts with thousands marks, now and then
    without views or a time), and their fields read back from the html."""
    p = posts(spark, d)
    when = F.date_format("post_datetime", "yyyy-MM-dd'T'HH:mm:ss")
    html = F.concat(
        F.lit('<article><a rel="author" href="/u">@'), F.col("account_id").cast("string"), F.lit("</a><p>"),
        F.format_number("likes", 0), F.lit(" likes</p><p>"), F.format_number(F.coalesce("comments", F.lit(0)), 0),
        F.lit(" comments</p>"),
        F.when(F.col("saves") % 2 == 0, F.concat(F.lit("<p>"), F.format_number("impressions", 0), F.lit(" views</p>"))).otherwise(""),
        F.when(F.col("saves") % 3 != 0, F.concat(F.lit('<time class="t" datetime="'), when, F.lit('">then</time>'))).otherwise(""))
    pages = p.select("post_id", html.alias("html"))
    return M.post_time_fields(TO.page_fields(pages)).select("post_id", "likes", "comments_count", "views", "username", "hour", "week")


@register("score_posts_formula", with_(POSTS_CTE, _PAGES + "SELECT * FROM scored"))
def q_score_posts_formula(spark, d):
    """M4 + M5 + B11 + B12 on scraped rows, with a formula as the model."""
    return M.score_posts(_scraped(spark, d), _model(), M.column_defaults(posts(spark, d))).select(*_SCORED)


@register("scored_summary_formula", with_(POSTS_CTE, _PAGES + """
SELECT round(avg(predicted_engagement), 6) AS avg_predicted, round(avg(viral_coefficient), 6) AS avg_vc,
       arg_max(link, (predicted_engagement, link)) AS best_link, max(predicted_engagement) AS best_predicted FROM scored"""))
def q_scored_summary_formula(spark, d):
    """D18 on the rows that the formula scored."""
    return M.scored_summary(q_score_posts_formula(spark, d))


@register("score_stream_formula", with_(POSTS_CTE, _PAGES + "SELECT * FROM scored"))
def q_score_stream_formula(spark, d):
    """The same feature rows arriving as files, scored on arrival."""
    from postlens.streaming import streams as ST
    base = os.path.join(checkpoint_dir(spark), f"scored-{uuid.uuid4().hex}")
    rows = M.feature_rows(_scraped(spark, d), M.column_defaults(posts(spark, d)))
    rows.write.parquet(f"{base}/src")
    stream = ST.read_stream(spark, f"{base}/src", spark.read.parquet(f"{base}/src").schema)
    ST.run_to_files(ST.score_stream(stream, _model()).select(*_SCORED), f"{base}/out", f"{base}/chk")
    return spark.read.parquet(f"{base}/out")
