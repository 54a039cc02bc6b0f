"""Registered queries: learning, scoring and stores (K, M, D16-D18, E4, A4-A9, B21)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from postlens.functions import text as TX
from postlens.operators import enrich as N
from postlens.operators import learn as K
from postlens.operators import scoring as M
from postlens.operators import textops as TO
from postlens.plans.q_core import posts
from postlens.plans.q_text import LABELLED_SQL, _labelled
from postlens.plans.registry import register
from postlens.plans.sqlbase import POSTS_CTE, with_
from postlens.session import checkpoint_dir
from postlens.sources.comments import comments_from_tables
from postlens.sources import store as S

MODEL_VERSION = 5          # part of the model-store key: bump when a pipeline changes


def _scratch(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


@register("split_rows", with_(POSTS_CTE, """
SELECT post_id, CAST('0x' || substr(md5(post_id || '42'), 1, 8) AS BIGINT) % 100 < 80 AS is_train FROM posts"""))
def q_split_rows(spark, d):
    """K3: deterministic 80/20 split."""
    return posts(spark, d).select("post_id", K.split_flag("post_id").alias("is_train"))


@register("class_weights", """
WITH l AS (""" + LABELLED_SQL + """),
c AS (SELECT label, count(*) AS n_class FROM l GROUP BY label)
SELECT label, n_class, round((SELECT count(*) FROM l) / ((SELECT count(*) FROM c) * n_class), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    """K7: balanced class weights of the labelled corpus."""
    return K.class_weights(_labelled(spark, d))


@register("cv_folds", """
WITH l AS (""" + LABELLED_SQL + """),
h AS (SELECT label, md5(coalesce(text, '') || '42') AS h, count(*) AS cnt FROM l GROUP BY ALL),
r AS (SELECT label, cnt, sum(cnt) OVER (PARTITION BY label ORDER BY h) - cnt AS less FROM h)
SELECT label, CAST(less % 3 AS BIGINT) AS fold, CAST(sum(cnt) AS BIGINT) AS n FROM r GROUP BY ALL""")
def q_cv_folds(spark, d):
    """K8 fold table: rows per (label, fold) of the corpus texts, all labels."""
    return (K.with_folds(_labelled(spark, d), label="label", id_col="text")
            .groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")))


def _engagement(spark, d):
    """The posts engagement model: loaded from the model store when this input
    was already fitted with these parameters (A7), else trained and stored."""
    data = N.model_columns(posts(spark, d).withColumnRenamed("post_id", "__pid"))
    key = f"engagement-v{MODEL_VERSION}-" + S.input_fingerprint(data) + f"-{K.FIRST_FIT_TREES}-{K.MAX_DEPTH}"

    def fit():
        model, metrics, _ = K.train_engagement_model(data, id_col="__pid")
        return model, metrics

    model, metrics = S.load_or_fit(spark, key, fit)
    return model, metrics, K.feature_columns(data)


@register("engagement_model")
def q_engagement_model(spark, d):
    """K2 + K3 + K4: random-forest engagement model on posts, held-out metrics."""
    return _engagement(spark, d)[1].select("mae", "r2", "n_train", "n_test", "n_augmented",
                                           "n_trees", "timestamp")


def _classified(spark, d):
    key = f"comments-v{MODEL_VERSION}-" + S.input_fingerprint(
        *[spark.read.parquet(f"{d}/{t}.parquet") for t in ("conversations", "documents", "labels")])

    def fit():
        corpus = _labelled(spark, d)
        return K.fit_comment_classifier(corpus), corpus.groupBy("label").count()

    model, _ = S.load_or_fit(spark, key, fit)
    tagged = TO.tag_comments(comments_from_tables(spark, d))
    return K.classify_comments(model, tagged)


@register("tag_comments")
def q_tag_comments(spark, d):
    """J4 + K6: classifier label / confidence with relatability, polarity, flags."""
    return _classified(spark, d).drop("comment_text")


@register("category_sentiment")
def q_category_sentiment(spark, d):
    """Per-category sentiment summary with awareness level."""
    return TO.category_sentiment(_classified(spark, d))


@register("top_comments")
def q_top_comments(spark, d):
    """Most relatable comments labelled Relatable."""
    return TO.top_comments(_classified(spark, d))


@register("cross_validate")
def q_cross_validate(spark, d):
    """K8: 3-fold accuracy of the comment classifier."""
    return K.cross_validate(_labelled(spark, d))


MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in M.MEDIAN_COLS)


@register("column_defaults", with_(POSTS_CTE, f""",
m AS (SELECT {MEDIANS} FROM posts),
a AS (SELECT account_type FROM posts WHERE account_type IS NOT NULL GROUP BY account_type
      ORDER BY count(*) DESC, account_type LIMIT 1),
c AS (SELECT content_category FROM posts WHERE content_category IS NOT NULL GROUP BY content_category
      ORDER BY count(*) DESC, content_category LIMIT 1)
SELECT {", ".join(f"round({c}, 6) AS {c}" for c in M.MEDIAN_COLS)}, a.account_type, c.content_category,
       9.0 AS hour, 1.0 AS day_num, 4.0 AS month_num, 16.0 AS week, 1.0 AS has_call_to_action,
       'reel' AS media_type, 'Hashtags' AS traffic_source
FROM m, a, c"""))
def q_column_defaults(spark, d):
    """Medians, modes and constants for unscrapable features."""
    return M.column_defaults(posts(spark, d))


TS_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 13 HOUR, '%Y-%m-%dT%H:%M:%SZ')
                WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'not a date' END"""


@register("post_time_fields", f"""
WITH t AS (SELECT o_orderkey, {TS_TEXT} AS ts_text FROM orders),
p AS (SELECT *, TRY_CAST(replace(ts_text, 'Z', '') AS TIMESTAMP) AS ts FROM t)
SELECT o_orderkey, ts_text, coalesce(hour(ts), 9) AS hour, coalesce(isodow(ts) - 1, 1) AS day_num,
       coalesce(month(ts), 4) AS month_num, coalesce(weekofyear(ts), 16) AS week FROM p""")
def q_post_time_fields(spark, d):
    """M6: time fields from ISO text with defaults."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 13 HOURS"),
                                         "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k == 2, F.lit("not a date")))
    return M.post_time_fields(o.select("o_orderkey", text.alias("ts_text")), ts_text="ts_text").select(
        "o_orderkey", "ts_text", "hour", "day_num", "month_num", "week")


@register("reach_estimates", with_(POSTS_CTE, """,
v AS (SELECT post_id, likes, coalesce(comments, 0) AS c, follower_count AS fc,
             CASE WHEN saves % 2 = 0 THEN impressions ELSE 0 END AS views FROM posts),
e AS (SELECT *, CASE WHEN fc > 0 THEN least(greatest(likes * 5 + c * 10, likes + c), fc)
                     ELSE likes * 5 + c * 10 END AS est FROM v)
SELECT post_id, CASE WHEN views > 0 THEN CAST(floor(views * 0.6) AS BIGINT) ELSE est END AS reach_est,
       CASE WHEN views > 0 THEN views ELSE CAST(floor(est * 1.3) AS BIGINT) END AS impressions_est FROM e"""))
def q_reach_estimates(spark, d):
    """M1-M3: reach and impressions estimated from views or likes/comments."""
    from postlens.functions import columns as C
    p = posts(spark, d).select("post_id", "likes", F.coalesce("comments", F.lit(0)).alias("c"),
                               F.col("follower_count").alias("fc"),
                               F.when(F.col("saves") % 2 == 0, F.col("impressions")).otherwise(0).alias("views"))
    est = C.estimate_reach("likes", "c", "fc")
    return p.select("post_id",
                    F.when(F.col("views") > 0, C.trunc_int(F.col("views") * 0.6)).otherwise(est).alias("reach_est"),
                    F.when(F.col("views") > 0, F.col("views")).otherwise(C.estimate_impressions(est))
                    .alias("impressions_est"))


def _scored_pages(spark, d):
    p = posts(spark, d)
    model, _, (num, cat) = _engagement(spark, d)
    defaults = M.column_defaults(p)
    pages = TO.page_posts(TO.page_fields(spark.read.parquet(f"{d}/pages.parquet")), keep=list(TO.PAGE_PATTERNS))
    return M.score_posts(M.post_time_fields(pages), model, defaults, cat_features=cat, features=num + cat,
                         hashtag="fitness", keep=("username", "post_datetime"))


@register("score_posts")
def q_score_posts(spark, d):
    """M4 + M5 + K9 + B11 + B12: stored pages scored by the engagement model."""
    return _scored_pages(spark, d)


@register("scored_summary")
def q_scored_summary(spark, d):
    """Summary of the scored pages."""
    return M.scored_summary(_scored_pages(spark, d))


@register("pool_append", with_(POSTS_CTE, """,
b1 AS (SELECT post_id FROM posts WHERE post_datetime < TIMESTAMP '1998-01-01'),
b2 AS (SELECT post_id FROM posts),
added AS (SELECT count(*) AS n FROM b2 WHERE post_id NOT IN (SELECT post_id FROM b1))
SELECT CAST((SELECT n FROM added) AS BIGINT) AS added,
       CAST((SELECT count(*) FROM b1) + (SELECT n FROM added) AS BIGINT) AS total"""))
def q_pool_append(spark, d):
    """A5 (+F1, F2): all posts appended to a pool that holds those before 1998."""
    p = posts(spark, d).select(F.col("post_id").alias("link"), "post_datetime", "media_type",
                               "likes", "engagement_rate")
    path = _scratch(spark, "pool")
    S.pool_append(p.where(F.col("post_datetime") < F.lit("1998-01-01").cast("timestamp_ntz")), path)
    return S.pool_append(p.drop("likes"), path)


@register("pool_preview", with_(POSTS_CTE, """
SELECT post_id AS link, post_datetime AS scraped_at, media_type FROM posts
ORDER BY post_datetime DESC, post_id LIMIT 50"""))
def q_pool_preview(spark, d):
    """Last 50 pool rows."""
    p = posts(spark, d).select(F.col("post_id").alias("link"), F.col("post_datetime").alias("scraped_at"),
                               "media_type")
    path = _scratch(spark, "pool")
    S.pool_append(p.where(F.col("scraped_at") < F.lit("1998-01-01").cast("timestamp_ntz")), path)
    S.pool_append(p, path)
    return S.pool_preview(spark.read.option("mergeSchema", "true").parquet(path),
                          columns=["link", "scraped_at", "media_type"])


@register("run_deltas", with_(POSTS_CTE, """,
l AS (SELECT round(avg(engagement_rate), 5) AS mae, round(avg(save_to_share) / 100, 4) AS r2,
             count(*) AS n_train, CAST(year AS VARCHAR) || '-01-01T00:00:00' AS timestamp
      FROM posts GROUP BY year)
SELECT mae, r2, n_train, timestamp, CAST(row_number() OVER (ORDER BY timestamp) AS BIGINT) AS run,
       round(mae - lag(mae) OVER (ORDER BY timestamp), 6) AS mae_delta,
       round(r2 - lag(r2) OVER (ORDER BY timestamp), 6) AS r2_delta,
       mae < lag(mae) OVER (ORDER BY timestamp) AS mae_improved,
       r2 > lag(r2) OVER (ORDER BY timestamp) AS r2_improved FROM l"""))
def q_run_deltas(spark, d):
    """A4 + B21: metrics records appended to a training log, read back, deltas."""
    p = posts(spark, d)
    runs = p.groupBy("year").agg(
        F.round(F.avg("engagement_rate"), 5).alias("mae"), F.round(F.avg("save_to_share") / 100, 4).alias("r2"),
        F.count(F.lit(1)).alias("n_train"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01T00:00:00")).alias("timestamp"))
    path = _scratch(spark, "log")
    S.training_log_append(runs.select("mae", "r2", "n_train", F.lit(None).alias("n_test"),
                                      F.lit(0).alias("n_augmented"), F.lit(100).alias("n_trees"),
                                      "timestamp"), path)
    log = S.training_log_read(spark, path)
    return N.run_deltas(log).select("mae", "r2", "n_train", "timestamp", "run", "mae_delta", "r2_delta",
                                    "mae_improved", "r2_improved")


TOPIC_SQL = " ".join(f"WHEN contains(lower(caption || ' '), '{k}') THEN '{c}'"
                     for k, c in TX.CATEGORY_KEYWORDS)


@register("feature_rows", with_(POSTS_CTE, f""",
m AS (SELECT quantile_cont(follower_count, 0.5) AS fc, quantile_cont(likes, 0.5) AS lk,
             quantile_cont(comments, 0.5) AS cm, quantile_cont(shares, 0.5) AS sh,
             quantile_cont(saves, 0.5) AS sv, quantile_cont(followers_gained, 0.5) AS fg FROM posts),
a AS (SELECT account_type FROM posts WHERE account_type IS NOT NULL GROUP BY account_type
      ORDER BY count(*) DESC, account_type LIMIT 1),
pg AS (SELECT url AS link, CASE WHEN contains(url, '/reel/') THEN 'reel' ELSE 'image' END AS media_type,
              regexp_extract(html, '<title>(.*?)</title>', 1) AS caption FROM pages)
SELECT link, round(fc, 6) AS follower_count, round(lk, 6) AS likes, round(cm, 6) AS comments,
       CAST(length(caption) AS BIGINT) AS caption_length,
       CAST(len(regexp_extract_all(caption, '#[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS hashtags_count,
       CAST(CASE WHEN {" OR ".join(f"contains(lower(caption), '{w}')" for w in TX.CTA_PHRASES)}
            THEN 1 ELSE 0 END AS DOUBLE) AS has_call_to_action,
       9 AS hour, 1 AS day_num, 4 AS month_num, 16 AS week, 0 AS reach, 0 AS impressions,
       CAST(trunc(sh) AS BIGINT) AS shares, CAST(trunc(sv) AS BIGINT) AS saves,
       CAST(trunc(fg) AS BIGINT) AS followers_gained, media_type, a.account_type,
       CASE {TOPIC_SQL} ELSE 'Technology' END AS content_category, 'Hashtags' AS traffic_source
FROM pg, m, a"""))
def q_feature_rows(spark, d):
    """M4 (+ M1-M3, M6, J8, D17): model-ready rows for stored pages."""
    pages = M.post_time_fields(TO.page_posts(spark.read.parquet(f"{d}/pages.parquet"))
                               .withColumn("post_datetime", F.lit(None).cast("string")))
    return M.feature_rows(pages, M.column_defaults(posts(spark, d)))


@register("baseline_metrics", with_(POSTS_CTE, """,
s AS (SELECT *, CAST('0x' || substr(md5(post_id || '42'), 1, 8) AS BIGINT) % 100 < 80 AS is_train FROM posts),
m AS (SELECT content_category, avg(engagement_rate) AS pred FROM s WHERE is_train GROUP BY content_category),
t AS (SELECT s.engagement_rate AS y, m.pred FROM s JOIN m USING (content_category) WHERE NOT is_train)
SELECT round(avg(abs(y - pred)), 5) AS mae,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 4) AS r2, count(*) AS n_test FROM t"""))
def q_baseline_metrics(spark, d):
    """K3 + K4: held-out MAE / R² of the per-category training mean."""
    p = posts(spark, d).withColumn("is_train", K.split_flag("post_id"))
    means = (p.where("is_train").groupBy("content_category")
             .agg(F.avg("engagement_rate").alias("prediction")))
    test = p.where("NOT is_train").join(means, "content_category")
    return K.regression_metrics(test)


@register("scan_posts", with_(POSTS_CTE, """
SELECT post_id, likes, comments, round(engagement_rate, 6) AS engagement_rate, hour, week, year,
       viral_score FROM posts"""))
def q_scan_posts(spark, d):
    """A1 + B1-B5 + C4 + B4n: posts exported as CSV (ragged header names, text
    timestamps), read back with an explicit schema and ingested."""
    from postlens.sources.posts import posts_from_tables, scan_posts, ingest_posts
    raw = posts_from_tables(spark, d)
    out = _scratch(spark, "csv")
    (raw.select(*[F.col(c).cast("string").alias(f" {c.upper()} ") if c == "post_datetime"
                  else F.col(c).alias(f" {c.upper()} ") for c in raw.columns])
     .write.option("header", True).csv(out))
    back = ingest_posts(scan_posts(spark, out))
    return back.select("post_id", "likes", "comments", "engagement_rate", "hour", "week", "year",
                       "viral_score")


@register("predictions_sink", with_(POSTS_CTE, """,
m AS (SELECT content_category, media_type, avg(engagement_rate) AS pred FROM posts GROUP BY ALL)
SELECT post_id, CAST(likes AS VARCHAR) AS likes,
       CASE WHEN pred >= 0.08 THEN 'VIRAL' WHEN pred >= 0.05 THEN 'HIGH'
            WHEN pred >= 0.03 THEN 'MEDIUM' WHEN pred >= 0.01 THEN 'LOW'
            ELSE 'VERY LOW' END AS engagement_tier FROM posts JOIN m USING (content_category, media_type)"""))
def q_predictions_sink(spark, d):
    """Rows scored by the mean of their category and media type, written as CSV
    (overwrite) and read back as text."""
    from postlens.functions import columns as C
    p = posts(spark, d)
    means = (p.groupBy("content_category", "media_type")
             .agg(F.avg("engagement_rate").alias("predicted_engagement")))
    scored = p.join(means, ["content_category", "media_type"]).select(
        "post_id", "likes", C.engagement_band("predicted_engagement").alias("engagement_tier"))
    path = _scratch(spark, "sink")
    S.predictions_sink(scored, path)
    return spark.read.option("header", True).csv(path)


@register("model_store")
def q_model_store(spark, d):
    """A7 + K9: the engagement model saved and loaded; predictions of the loaded pipeline."""
    data = N.model_columns(posts(spark, d).withColumnRenamed("post_id", "__pid"))
    model, metrics, (num, cat) = _engagement(spark, d)
    path = _scratch(spark, "model")
    S.model_store_save(model, metrics, path)
    loaded, _ = S.model_store_load(spark, path)
    return K.batch_predict(loaded, data, cat).select("__pid", "predicted_engagement")


@register("retrain")
def q_retrain(spark, d):
    """K5: base + pool rows (labels from the pool), tree count from the pool size."""
    p = posts(spark, d)
    base = p.where(F.col("media_type") != "reel")
    pool = p.where(F.col("media_type") == "reel").select(
        F.col("post_id").alias("link"), "likes", "shares", "saves", "reach", "media_type",
        "content_category", "engagement_rate", F.lit("scraped").alias("label_source"))
    _, metrics, _ = K.retrain(base, pool)
    return metrics


@register("score_stream")
def q_score_stream(spark, d):
    """Feature rows of the stored pages arrive as files and are scored on
    arrival by the stored engagement model (availableNow trigger)."""
    from postlens.streaming import streams as ST
    p = posts(spark, d)
    model, _, (num, cat) = _engagement(spark, d)
    pages = TO.page_posts(spark.read.parquet(f"{d}/pages.parquet"))
    rows = M.feature_rows(pages, M.column_defaults(p), features=num + cat)
    src, out, chk = _scratch(spark, "src"), _scratch(spark, "scored"), _scratch(spark, "chk")
    rows.write.parquet(src)
    stream = ST.read_stream(spark, src, spark.read.parquet(src).schema)
    scored = ST.score_stream(stream, model, cat_features=cat)
    ST.run_to_files(scored, out, chk)
    return spark.read.parquet(out)
