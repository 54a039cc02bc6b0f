"""Filters (C), aggregations (D) and top-k / ranking (E) over posts.

Aggregations are hash aggregates with partial (map-side) combine, so a hot key
is pre-aggregated in every task before the shuffle.  Orderings of aggregated
results always carry a key tie-break (pandas' ``idxmax`` takes the first key
in ascending order).  Windows without a partition only run on aggregated,
size-bounded results.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.functions.scalars import scalar, scalar_struct
from postlens.operators import orderstats as O

METRIC = "engagement_rate"


# ============================================================== C: filters
def facet_filter(df: DataFrame, *, categories: Sequence[str] = (), media: Sequence[str] = (),
                 accounts: Sequence[str] = (), followers: tuple | None = None,
                 dates: tuple | None = None, category="content_category",
                 media_col="media_type", account_col="account_type",
                 follower_col="follower_count", ts="post_datetime", date_col="post_date") -> DataFrame:
    """IN lists (empty = no filter), inclusive follower range and date range.

    The date range is on the date column where the table has one (a plain column
    of the files, so the bounds reach the Parquet scan), else on the time.
    """
    cond = F.lit(True)
    if categories:
        cond &= F.col(category).isin(list(categories))
    if media:
        cond &= F.col(media_col).isin(list(media))
    if accounts:
        cond &= F.col(account_col).isin(list(accounts))
    if followers is not None:
        cond &= (F.col(follower_col) >= followers[0]) & (F.col(follower_col) <= followers[1])
    if dates is not None:
        d0, d1 = (_dt.date.fromisoformat(str(d)) for d in dates)
        if date_col in df.columns:
            return df.where(cond & (F.col(date_col) >= F.lit(d0)) & (F.col(date_col) <= F.lit(d1)))
        lo = _dt.datetime.combine(d0, _dt.time())
        hi = _dt.datetime.combine(d1 + _dt.timedelta(days=1), _dt.time())
        # string literals parse to timestamp_ntz without any session-zone shift
        cond &= ((F.col(ts) >= F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz"))
                 & (F.col(ts) < F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz")))
    return df.where(cond)


def page_filter(df: DataFrame, *, media: str = "All", dates: tuple | None = None,
                media_col="media_type", ts="post_datetime") -> DataFrame:
    """Media type equal unless "All", inclusive date range."""
    out = df if media == "All" else df.where(F.col(media_col) == media)
    return facet_filter(out, dates=dates, ts=ts) if dates else out


def require_metric(df: DataFrame, subset: Sequence[str] | None = (METRIC,)) -> DataFrame:
    """C4: drop rows with a null in ``subset`` (None = any column)."""
    return df.dropna(subset=list(subset)) if subset else df.dropna()


def min_support(agg: DataFrame, *, n_col: str = "n_posts", k: int = 5) -> DataFrame:
    """Keep groups with at least ``k`` rows."""
    return agg.where(F.col(n_col) >= k)


def facet_values(df: DataFrame, facets: Sequence[str] = ("content_category", "media_type",
                                                         "account_type")) -> DataFrame:
    """C2 (value lists): sorted distinct non-null values per facet, long form.

    Long form (facet, value) keeps an unbounded facet from being gathered into
    a single group; the distinct runs distributed.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets
    ])).alias("s")).select("s.facet", "s.value")
    return stacked.where(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def facet_ranges(df: DataFrame, *, follower_col="follower_count", ts="post_datetime") -> DataFrame:
    """C2 (ranges): min/max follower count and min/max date, one row."""
    return df.agg(F.min(follower_col).alias("min_followers"),
                  F.max(follower_col).alias("max_followers"),
                  F.to_date(F.min(ts)).alias("min_date"),
                  F.to_date(F.max(ts)).alias("max_date"))


def trend_predicates(trend: DataFrame, *, velocity: str = "velocity_pct") -> DataFrame:
    """Number of rising (> .5) and declining (< -.5) topics; one row."""
    return trend.agg(F.count_if(F.col(velocity) > 0.5).alias("rising_cnt"),
                     F.count_if(F.col(velocity) < -0.5).alias("declining_cnt"))


def rising_topics(trend: DataFrame, *, velocity: str = "velocity_pct", k: int = 4,
                  key: str = "content_category") -> DataFrame:
    """First ``k`` topics with positive velocity in velocity order."""
    return (trend.where(F.col(velocity) > 0)
            .orderBy(F.col(velocity).desc(), F.col(key)).limit(k))


# ============================================================== D: aggregates
def kpi_summary(df: DataFrame, *, metric: str = METRIC) -> DataFrame:
    """Count, avg metric, avg likes, sum reach, sum impressions, avg viral score."""
    cols = set(df.columns)
    opt = lambda f, c, d: f(c) if c in cols else F.lit(d)
    return df.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.avg(metric).alias("avg_engagement"),
        opt(F.avg, "likes", 0).alias("avg_likes"),
        opt(F.sum, "reach", 0).alias("total_reach"),
        opt(F.sum, "impressions", 0).alias("total_impr"),
        opt(F.avg, "viral_score", 0).alias("avg_viral"),
    )


def mean_by_key(df: DataFrame, *, keys: Sequence[str] | str, metric: str = METRIC,
                with_count: bool = True) -> DataFrame:
    """Average metric per key (null keys dropped, as pandas groupby)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    nn = F.lit(True)
    for k in keys:
        nn &= F.col(k).isNotNull()
    aggs = [F.avg(metric).alias("avg_metric")]
    if with_count:
        aggs.append(F.count(metric).alias("n_posts"))
    return df.where(nn).groupBy(*keys).agg(*aggs)


def best_key(df: DataFrame, *, keys: Sequence[str] = ("hour", "content_category",
                                                      "media_type", "day"),
             metric: str = METRIC) -> DataFrame:
    """D3: for each key, the value with the highest average metric, in one scan.

    One ``GROUPING SETS`` aggregate (Expand + partial aggregation) replaces one
    scan per key; ties go to the smallest key value.
    """
    keys = list(keys)
    g = df.groupingSets([[k] for k in keys], *keys).agg(
        F.avg(metric).alias("avg_metric"), F.grouping_id().alias("gid"))
    n = len(keys)
    # grouping_id bit for key i is set when the key is aggregated away
    gid_of = {k: sum(1 << (n - 1 - j) for j in range(n) if j != i) for i, k in enumerate(keys)}
    key_name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for k in keys:
        key_name = F.when(F.col("gid") == gid_of[k], F.lit(k)).otherwise(key_name)
        value = F.when(F.col("gid") == gid_of[k], F.col(k).cast("string")).otherwise(value)
    g = g.withColumn("key_name", key_name).withColumn("best_value", value)
    # a value without any metric is no candidate (idxmax skips NaN)
    g = g.where(F.col("best_value").isNotNull() & F.col("avg_metric").isNotNull())
    # best = smallest (-avg, typed key): a min_by aggregate, partial per task,
    # rather than a window holding every value of a key
    order = F.struct(-F.col("avg_metric"), *[F.col(k) for k in keys])
    best = F.min_by(F.struct("best_value", "avg_metric"), order)
    return (g.groupBy("key_name").agg(best.alias("b"))
            .select("key_name", F.col("b.best_value").alias("best_value"),
                    F.col("b.avg_metric").alias("best_avg")))


def monthly_trend(df: DataFrame, *, metric: str = METRIC) -> DataFrame:
    """Average metric by (month_num, month)."""
    return mean_by_key(df, keys=["month_num", "month"], metric=metric, with_count=False)


def weekday_profile(df: DataFrame, *, metric: str = METRIC) -> DataFrame:
    """Average metric per weekday, Monday first; absent days dropped."""
    return mean_by_key(df, keys=["day_num", "day"], metric=metric, with_count=False)


def actions_by_media(df: DataFrame, *, media: str = "media_type",
                     actions: Sequence[str] = ("likes", "shares", "saves")) -> DataFrame:
    """Average of each action per media type."""
    return (df.where(F.col(media).isNotNull()).groupBy(media)
            .agg(*[F.avg(a).alias(f"avg_{a}") for a in actions]))


def tier_funnel(df: DataFrame, *, tier: str = "tier",
                order: Sequence[str] = ("Viral", "High", "Medium", "Low")) -> DataFrame:
    """Count per tier in a fixed order and % of the first present tier."""
    pos = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(tier))
    counts = (df.where(F.col(tier).isin(list(order))).groupBy(tier)
              .agg(F.count(F.lit(1)).alias("n_posts"))
              .withColumn("stage", pos.cast("int")))
    w = Window.orderBy("stage")  # ≤ len(order) rows
    return counts.withColumn(
        "pct_of_first", F.col("n_posts") * 100.0 / F.first("n_posts").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def topic_viral_ranking(df: DataFrame, *, category: str = "content_category",
                        metric: str = METRIC, id_col: str = "post_id") -> DataFrame:
    """Per category averages, save:share of the means, organic growth score
    (.6·vc + .4·ratio) and rank 1..n (ties by category)."""
    cols = set(df.columns)
    avg_if = lambda c, out: (F.avg(c) if c in cols else F.lit(None).cast("double")).alias(out)
    agg = (df.where(F.col(category).isNotNull()).groupBy(category).agg(
        avg_if("vc_raw", "avg_vc"), avg_if("saves", "avg_saves"), avg_if("shares", "avg_shares"),
        avg_if("likes", "avg_likes"), avg_if("high_value_ratio", "avg_high_value_ratio"),
        avg_if(metric, "avg_engagement"),
        F.count(id_col if id_col in cols else metric).alias("n_posts")))
    ratio = F.coalesce(F.try_divide(F.col("avg_saves"), F.nullif(F.col("avg_shares"), F.lit(0.0))),
                       F.col("avg_saves"))
    agg = agg.withColumn("save_to_share_ratio", ratio)
    agg = agg.withColumn("organic_growth_score", F.coalesce(
        F.col("avg_vc") * 0.6 + F.col("save_to_share_ratio") * 0.4, F.col("avg_vc")))
    w = Window.orderBy(F.col("organic_growth_score").desc_nulls_last(), F.col(category))
    return agg.withColumn("rank", F.row_number().over(w))  # one row per category: small


def action_quality(df: DataFrame, *, category: str = "content_category") -> DataFrame:
    """Per category avg high-value (saves+shares), avg passive (likes), high-value %."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    agg = (df.where(F.col(category).isNotNull()).groupBy(category)
           .agg(F.avg(z("saves") + z("shares")).alias("high_value"),
                F.avg(z("likes")).alias("passive")))
    return agg.withColumn("high_value_pct", F.try_divide(
        F.col("high_value"), F.col("high_value") + F.col("passive")) * 100)


def virality_kpis(vc: DataFrame, *, category: str = "content_category") -> DataFrame:
    """Avg and max VC, Mega-Viral count, top viral category; one row.

    One aggregate per category (null category kept as a group) feeds both the
    global KPIs and the D9 ranking, so the facts are read once."""
    z = lambda c: F.col(c) if c in vc.columns else F.lit(None).cast("double")
    per = O.materialized(vc.groupBy(category).agg(
        F.sum("vc_raw").alias("s_vc"), F.count("vc_raw").alias("n_vc"), F.max("vc_raw").alias("max_vc"),
        F.count_if(F.col("vc_tier") == "Mega-Viral").alias("mega"),
        F.avg(z("saves")).alias("avg_saves"), F.avg(z("shares")).alias("avg_shares")))
    ratio = F.coalesce(F.try_divide(F.col("avg_saves"), F.nullif(F.col("avg_shares"), F.lit(0.0))),
                       F.col("avg_saves"))
    avg_vc = F.col("s_vc") / F.col("n_vc")
    score = F.coalesce(avg_vc * 0.6 + ratio * 0.4, avg_vc)
    top = (per.where(F.col(category).isNotNull() & score.isNotNull())
           .agg(F.min_by(F.col(category), F.struct((-score).alias("o"), F.col(category))).alias("t")))
    return per.agg((F.sum("s_vc") / F.sum("n_vc")).alias("avg_vc"), F.max("max_vc").alias("peak_vc"),
                   F.sum("mega").alias("mega_cnt")).withColumn("top_category", scalar(top))


def _flag_best(agg: DataFrame, key: str, metric: str, out: str) -> DataFrame:
    """Marks the row with the largest ``metric`` (the least key on ties); the winner is an
    aggregate, so a key of any cardinality stays distributed."""
    best = agg.where(F.col(metric).isNotNull()).agg(F.min_by(key, F.struct(-F.col(metric), F.col(key))).alias("b"))
    return agg.withColumn(out, F.coalesce(F.col(key) == scalar(best), F.lit(False)))


def cta_impact(df: DataFrame, *, cta: str = "has_call_to_action", metric: str = METRIC) -> DataFrame:
    """Avg metric per CTA flag rounded to 5 places, best flag marked."""
    agg = (df.where(F.col(cta).isNotNull()).groupBy(cta)
           .agg(F.round(F.avg(metric), 5).alias("avg_metric")))
    return _flag_best(agg, cta, "avg_metric", "is_best")


def hashtag_effectiveness(df: DataFrame, *, key: str = "hashtags_count", metric: str = METRIC,
                          min_n: int = 10) -> DataFrame:
    """Avg metric and n per hashtag count, n ≥ min_n, best flagged.

    No group reaching ``min_n`` gives no rows.
    """
    agg = (df.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.avg(metric).alias("avg_engagement"), F.count(metric).alias("n_posts"))
           .where(F.col("n_posts") >= min_n))
    return _flag_best(agg, key, "avg_engagement", "is_optimal")


def optimal_hashtags(df: DataFrame, *, key: str = "hashtags_count", metric: str = METRIC,
                     default: int = 7) -> DataFrame:
    """Hashtag count with the best average (no support minimum), default 7."""
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(metric).alias("a"))
    best = agg.agg(F.max_by(F.col(key), F.struct(F.col("a"), -F.col(key))).alias("best"))
    return best.select(F.coalesce(F.col("best").cast("bigint"), F.lit(default).cast("bigint"))
                       .alias("optimal_hashtags"))


def value_histogram(df: DataFrame, *, col: str = "vc_raw", bins: int = 60,
                    cap_q: float = 0.99) -> DataFrame:
    """``bins`` equal-width bins of ``col`` clipped at its ``cap_q`` quantile."""
    # min (the 0-quantile) and the cap come from one rank table: one fact pass
    b = scalar_struct(O.exact_quantiles(df, col, [0.0, cap_q], names=["lo", "cap"]))
    lo, cap = b["lo"], b["cap"]
    v = F.least(F.col(col), F.col("cap"))
    width = (F.col("cap") - F.col("lo")) / bins
    b = F.when(F.col("cap") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((v - F.col("lo")) / width) + 1, F.lit(bins)))
    return (df.where(F.col(col).isNotNull()).withColumns({"lo": lo, "cap": cap})
            .groupBy(b.cast("int").alias("bin"), "lo", "cap").agg(F.count(F.lit(1)).alias("n_posts"))
            .select("bin",
                    (F.col("lo") + (F.col("bin") - 1) * (F.col("cap") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * (F.col("cap") - F.col("lo")) / bins).alias("bin_hi"),
                    "n_posts"))


# ============================================================== E: top-k
def top_posts(df: DataFrame, *, by: str = "vc_raw", k: int = 6, id_col: str = "post_id",
              columns: Sequence[str] = ("post_id", "content_category", "media_type", "vc_raw",
                                        "engagement_rate", "likes", "shares", "saves", "tier")
              ) -> DataFrame:
    """``k`` rows with the largest ``by`` (TakeOrderedAndProject), ties by id."""
    keep = [c for c in columns if c in df.columns]
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(id_col)).limit(k).select(*keep)


def best_n(df: DataFrame, *, key: str, metric: str = METRIC, n: int = 3,
           min_n: int = 5) -> DataFrame:
    """Top ``n`` keys by average metric among keys with ≥ ``min_n`` rows."""
    agg = min_support(mean_by_key(df, keys=key, metric=metric), k=min_n)
    top = agg.orderBy(F.col("avg_metric").desc(), F.col(key)).limit(n)   # distributed top-k
    w = Window.orderBy(F.col("avg_metric").desc(), F.col(key))           # ≤ n rows
    return top.withColumn("rank", F.row_number().over(w))


def best_days(df: DataFrame, *, metric: str = METRIC) -> DataFrame:
    """All weekdays ranked by average metric (n ≥ 5)."""
    return best_n(df, key="day", metric=metric, n=7)


def suggested_topics(df: DataFrame, *, category: str = "content_category",
                     media: str = "media_type", hour: str = "hour",
                     metric: str = METRIC, k: int = 4) -> DataFrame:
    """E5: top ``k`` categories, each with its best media type and best hour.

    One ``GROUPING SETS`` scan gives the (category), (category, media) and
    (category, hour) means; best values are ``min_by`` aggregates."""
    g = (df.where(F.col(category).isNotNull())
         .groupingSets([[category], [category, media], [category, hour]], category, media, hour)
         .agg(F.avg(metric).alias("avg_metric"), F.grouping_id().alias("gid")))
    g = O.materialized(g)          # small, read three times: one fact pass
    # grouping_id bits (category, media, hour): 3 = category only, 1 = +media, 2 = +hour
    cats = g.where((F.col("gid") == 3) & F.col("avg_metric").isNotNull()).select(category, "avg_metric")
    top = cats.orderBy(F.col("avg_metric").desc(), F.col(category)).limit(k)     # distributed top-k
    top = top.select(category, F.col("avg_metric").alias("avg_engagement"),
                     F.row_number().over(Window.orderBy(F.col("avg_metric").desc(), F.col(category)))
                     .alias("rank"))

    def best(gid, key):
        a = g.where((F.col("gid") == gid) & F.col(key).isNotNull() & F.col("avg_metric").isNotNull())
        b = F.min_by(F.col(key), F.struct(-F.col("avg_metric"), F.col(key)))
        return a.groupBy(category).agg(b.alias(f"best_{key}"))

    return top.join(best(1, media), category, "left").join(best(2, hour), category, "left")


def sample_rows(df: DataFrame, *, n: int = 2000, seed: int = 42, id_col: str = "post_id") -> DataFrame:
    """Deterministic sample of ``n`` rows: smallest md5(id || seed)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(n).drop("_h")
