"""Recommendations (L1-L4): factor scores, confidence, content calendar, strategies.

Ranked factor lists are ≤ 3 rows each; the calendar is 7 rows.  Evidence for
each (category, media) combination comes from one grouped aggregate joined to
the plan, not one filtered rescan per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.functions.scalars import scalar
from postlens.operators import explore as X

METRIC = "engagement_rate"
# Fallbacks when a factor has no qualifying group.
DEFAULT_HOUR, DEFAULT_CATEGORY, DEFAULT_MEDIA, DEFAULT_HASHTAGS, DEFAULT_CTA = 9, "Fitness", "reel", 7, 1
MIN_COMBO = 5
FACTOR_KEYS = ("hour", "content_category", "media_type", "hashtags_count", "has_call_to_action")


def factor_aggregates(df: DataFrame, *, metric: str = METRIC, keys=FACTOR_KEYS,
                      materialize: bool = True) -> DataFrame:
    """Every aggregate the recommender needs, from ONE scan of the facts:
    ``GROUPING SETS`` over each factor key, (category, media) and the total.

    Rows: gset (name of the set), the key columns, avg_metric, n_posts
    (non-null metric), n_rows.  The result has one row per key value, so it is
    written once (small) and all factor tables read it instead of the facts."""
    keys = [k for k in keys if k in df.columns]
    combo = ["content_category", "media_type"]
    sets = [[k] for k in keys] + [combo, []]
    g = df.groupingSets(sets, *keys).agg(
        F.avg(metric).alias("avg_metric"), F.count(metric).alias("n_posts"),
        F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("gid"))
    n = len(keys)
    name = F.lit(None).cast("string")
    for sset, label in [(st, "+".join(st) or "total") for st in sets]:
        gid = sum(1 << (n - 1 - j) for j, k in enumerate(keys) if k not in sset)
        ok = F.lit(True)
        for k in sset:                                  # a real null key is no group
            ok = ok & F.col(k).isNotNull()
        name = F.when((F.col("gid") == gid) & ok, F.lit(label)).otherwise(name)
    out = g.withColumn("gset", name).where(F.col("gset").isNotNull()).drop("gid")
    if materialize:
        from postlens.operators.orderstats import materialized
        out = materialized(out)
    return out


def _from(agg: DataFrame, key: str) -> DataFrame:
    return agg.where(F.col("gset") == key)


def _ranked_from(agg: DataFrame, key: str, n: int = 3, min_n: int = 5) -> DataFrame:
    """E2 over the factor aggregates: top ``n`` values with ≥ ``min_n`` rows."""
    top = (_from(agg, key).where(F.col("n_posts") >= min_n)
           .orderBy(F.col("avg_metric").desc(), F.col(key)).limit(n))
    w = Window.orderBy(F.col("avg_metric").desc(), F.col(key))      # ≤ n rows
    return top.select(F.col(key).alias("value"), "avg_metric", "n_posts",
                      F.row_number().over(w).alias("rank"))


def _optimal_hashtags_from(agg: DataFrame, key: str = "hashtags_count") -> "F.Column":
    best = _from(agg, key).agg(F.max_by(F.col(key), F.struct(F.col("avg_metric"), -F.col(key))).alias("b"))
    return F.coalesce(scalar(best).cast("bigint"), F.lit(DEFAULT_HASHTAGS).cast("bigint"))


def _best_cta_from(agg: DataFrame, key: str = "has_call_to_action") -> "F.Column":
    a = _from(agg, key).select(key, F.round("avg_metric", 5).alias("r"))
    best = a.agg(F.max_by(F.col(key), F.struct(F.col("r"), -F.col(key))).alias("b"))
    return F.coalesce(scalar(best).cast("int"), F.lit(DEFAULT_CTA))


def _combo_from(agg: DataFrame) -> DataFrame:
    return _from(agg, "content_category+media_type").select(
        F.col("content_category").alias("cat"), F.col("media_type").alias("media"),
        F.col("avg_metric").alias("combo_mean"), F.col("n_rows").alias("combo_n"))


def _global_mean_from(agg: DataFrame) -> "F.Column":
    return scalar(_from(agg, "total").select("avg_metric"))


def confidence_score(n: Column, effect: Column) -> Column:
    """L2: int(min(100, min(50, n) + min(50, 100·effect)))."""
    v = F.least(F.lit(100.0), F.least(F.lit(50.0), n.cast("double"))
                + F.least(F.lit(50.0), effect * 100))
    return C.trunc_int(v).cast("int")


def _top_list(r: DataFrame, name: str) -> DataFrame:
    # ≤ 3 rows: collecting them into an ordered array is size-bounded
    return r.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                             lambda s: s["value"]).alias(name))


def factor_scores(df: DataFrame, *, metric: str = METRIC) -> DataFrame:
    """L1: best hour / category / media / hashtag count / CTA, plus top-3 lists
    (scalar subqueries over the one-scan factor aggregates)."""
    agg = factor_aggregates(df, metric=metric)
    hours = scalar(_top_list(_ranked_from(agg, "hour"), "top_hours"))
    cats = scalar(_top_list(_ranked_from(agg, "content_category"), "top_categories"))
    media = scalar(_top_list(_ranked_from(agg, "media_type"), "top_media"))
    return df.sparkSession.range(1).select(
        F.coalesce(hours[0].cast("int"), F.lit(DEFAULT_HOUR)).alias("best_hour"),
        F.coalesce(cats[0], F.lit(DEFAULT_CATEGORY)).alias("best_category"),
        F.coalesce(media[0], F.lit(DEFAULT_MEDIA)).alias("best_media"),
        _optimal_hashtags_from(agg).alias("optimal_hashtags"),
        _best_cta_from(agg).alias("best_cta"),
        cats.alias("top_categories"), hours.cast("array<int>").alias("top_hours"),
        media.alias("top_media"))


def combo_evidence(df: DataFrame, *, cat: str = "content_category", media: str = "media_type",
                   metric: str = METRIC) -> DataFrame:
    """mean metric and row count per (category, media) — one aggregate."""
    return (df.groupBy(cat, media)
            .agg(F.avg(metric).alias("combo_mean"), F.count(F.lit(1)).alias("combo_n"))
            .where(F.col(cat).isNotNull() & F.col(media).isNotNull()))


def _cycle(r: DataFrame, name: str, default) -> DataFrame:
    """Rank table with its size, for ``pmod(day, size) = rank - 1`` lookups."""
    k = scalar(r.agg(F.count(F.lit(1)).alias(f"k_{name}")))
    return r.select(F.col("value").alias(name), (F.col("rank") - 1).alias(f"pos_{name}")), k


def content_calendar(df: DataFrame, *, metric: str = METRIC, days: int = 7) -> DataFrame:
    """L3: 7-day plan cycling through the top categories, media and hours;
    every input comes from the one-scan factor aggregates."""
    spark = df.sparkSession
    agg = factor_aggregates(df, metric=metric)
    cats, k_c = _cycle(_ranked_from(agg, "content_category"), "cat", DEFAULT_CATEGORY)
    med, k_m = _cycle(_ranked_from(agg, "media_type"), "media", DEFAULT_MEDIA)
    hrs, k_h = _cycle(_ranked_from(agg, "hour"), "hour", DEFAULT_HOUR)
    names = F.array(*[F.lit(d) for d in C.DAYS_OF_WEEK])
    cal = spark.range(days).select(
        F.col("id").cast("int").alias("i"), k_c.alias("k_cat"), k_m.alias("k_media"),
        k_h.alias("k_hour"), _optimal_hashtags_from(agg).alias("optimal_hashtags"),
        _best_cta_from(agg).alias("best_cta"), _global_mean_from(agg).alias("global_mean"))
    cal = (cal.join(cats, F.pmod("i", F.greatest("k_cat", F.lit(1))) == F.col("pos_cat"), "left")
              .join(med, F.pmod("i", F.greatest("k_media", F.lit(1))) == F.col("pos_media"), "left")
              .join(hrs, F.pmod("i", F.greatest("k_hour", F.lit(1))) == F.col("pos_hour"), "left"))
    cal = cal.select(
        "i", F.coalesce("cat", F.lit(DEFAULT_CATEGORY)).alias("cat"),
        F.coalesce("media", F.lit(DEFAULT_MEDIA)).alias("media"),
        F.coalesce(F.col("hour").cast("int"), F.lit(DEFAULT_HOUR)).alias("hour"),
        "optimal_hashtags", "best_cta", "global_mean")
    cal = cal.join(_combo_from(agg), ["cat", "media"], "left")   # ≤ #cat × #media rows
    pred = F.when(F.coalesce("combo_n", F.lit(0)) >= MIN_COMBO, F.col("combo_mean")) \
            .otherwise(F.col("global_mean"))
    n_obs = F.coalesce(F.col("combo_n"), F.lit(0))
    return cal.select(
        F.element_at(names, (F.pmod("i", F.lit(7)) + 1)).alias("day"),
        F.col("cat").alias("content_category"),
        F.initcap("media").alias("media_type_label"),
        C.clock_label("hour").alias("post_time"),
        F.concat(F.lit("#"), F.col("optimal_hashtags").cast("string")).alias("hashtags"),
        F.when(F.col("best_cta") == 1, "✅ Yes").otherwise("❌ No").alias("cta"),
        F.format_string("%.2f%%", pred * 100).alias("predicted_engagement"),
        confidence_score(n_obs, pred).alias("confidence"),
        pred.alias("pred_raw"), F.col("hour").alias("hour"), "i")


def top_strategies(df: DataFrame, *, metric: str = METRIC, n_strategies: int = 3) -> DataFrame:
    """L4: i-th best category with i-th best media and hour (missing → best)."""
    agg = factor_aggregates(df, metric=metric)
    cats = _ranked_from(agg, "content_category").select(
        F.col("value").alias("cat"), F.col("n_posts").alias("n_obs"), "rank")
    med = _ranked_from(agg, "media_type").select(F.col("value").alias("media"), "rank")
    hrs = _ranked_from(agg, "hour").select(F.col("value").cast("int").alias("hour"), "rank")
    plan = (cats.where(F.col("rank") <= n_strategies)
            .withColumns({"best_media": scalar(med.where("rank = 1"), "media"),
                          "best_hour": scalar(hrs.where("rank = 1"), "hour")})
            .join(med, "rank", "left").join(hrs, "rank", "left"))
    plan = plan.select("rank", "cat", F.coalesce("media", "best_media").alias("media"),
                       F.coalesce("hour", "best_hour").alias("hour"), "n_obs")
    plan = (plan.join(_combo_from(agg), ["cat", "media"], "left")
            .withColumns({"global_mean": _global_mean_from(agg),
                          "optimal_hashtags": _optimal_hashtags_from(agg),
                          "best_cta": _best_cta_from(agg)}))
    pred = F.when(F.coalesce("combo_n", F.lit(0)) >= MIN_COMBO, F.col("combo_mean")) \
            .otherwise(F.col("global_mean"))
    return plan.select(
        "rank", F.col("cat").alias("category"), "media", C.clock_label("hour").alias("hour"),
        F.col("optimal_hashtags").alias("hashtags"), F.col("best_cta").alias("cta"),
        pred.alias("pred_engagement"), confidence_score(F.col("n_obs"), pred).alias("confidence"),
        "n_obs")
