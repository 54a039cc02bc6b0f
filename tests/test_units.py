"""Edge rows of FIXTURES.md §4 and operator properties on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.functions import stats as S
from postlens.functions import text as TX
from postlens.operators import abtest as A
from postlens.operators import enrich as N
from postlens.operators import explore as X
from postlens.operators import orderstats as O
from postlens.operators import textops as TO
from postlens.operators import trend as T
from postlens.sources.posts import ingest_posts

P_SCHEMA = ("post_id string, content_category string, media_type string, likes bigint, "
            "comments bigint, shares bigint, saves bigint, reach bigint, engagement_rate double, "
            "post_datetime timestamp_ntz, hashtags_count int, hour int")


def posts(spark, rows):
    return spark.createDataFrame(rows, P_SCHEMA)


def row(i, cat="A", media="reel", likes=10, comments=1, shares=2, saves=3, reach=100,
        er=0.05, ts=dt.datetime(2024, 1, 1, 9), tags=3, hour=9):
    return (f"p{i}", cat, media, likes, comments, shares, saves, reach, er, ts, tags, hour)


def test_save_to_share_zero_shares(spark):
    df = posts(spark, [row(1, shares=0, saves=7)])
    out = df.select(C.save_to_share(df.columns).alias("s")).first().s
    assert out == 7


def test_vc_reach_zero_or_null_divides_by_one(spark):
    df = posts(spark, [row(1, reach=0, saves=1, shares=1, comments=2), row(2, reach=None, saves=1,
                                                                             shares=1, comments=2)])
    vals = [r.v for r in df.select(C.viral_coefficient(df.columns).alias("v")).collect()]
    assert vals == [8000.0, 8000.0]


def test_high_value_ratio_zero_actions(spark):
    df = posts(spark, [row(1, likes=0, comments=0, shares=0, saves=0)])
    assert df.select(C.high_value_ratio(df.columns).alias("h")).first().h == 0


def test_average_rank_percentile_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    out = O.avg_percent_rank(df, "v", "pct", ranks=O.value_ranks(df, "v", ranges=3))
    got = sorted((r.v, r.pct) for r in out.collect())
    assert got == [(1.0, 25.0), (2.0, 62.5), (2.0, 62.5), (3.0, 100.0)]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in [5, 1, 9, 3, 3, 7, 2, 8, 8, 8, 0.5]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.25, 0.5, 0.8, 0.95, 1.0]
    got = O.exact_quantiles(df, "v", probs).first()
    want = np.quantile(vals, probs)
    assert [round(x, 12) for x in got] == [round(float(x), 12) for x in want]


def test_quantile_bound_goes_to_upper_tier(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "engagement_rate double")
    out = {r.engagement_rate: r.tier for r in N.performance_tiers(df).collect()}
    # quartiles 2, 3, 4 → values equal to a bound take the upper tier
    assert out == {1.0: "Low", 2.0: "Medium", 3.0: "High", 4.0: "Viral", 5.0: "Viral"}


def test_min_support_four_vs_five(spark):
    rows = [row(i, cat="A") for i in range(4)] + [row(10 + i, cat="B") for i in range(5)]
    got = [r.content_category for r in X.best_n(posts(spark, rows), key="content_category").collect()]
    assert got == ["B"]


def test_hashtag_group_nine_vs_ten(spark):
    rows = [row(i, tags=3) for i in range(9)] + [row(20 + i, tags=4) for i in range(10)]
    got = [r.hashtags_count for r in X.hashtag_effectiveness(posts(spark, rows)).collect()]
    assert got == [4]


def test_hashtag_no_group_gives_no_rows(spark):
    assert X.hashtag_effectiveness(posts(spark, [row(1)])).count() == 0


def test_two_week_category_zero_slope_and_no_forecast(spark):
    rows = [row(1, ts=dt.datetime(2024, 1, 1), er=0.1), row(2, ts=dt.datetime(2024, 1, 8), er=0.3)]
    p = ingest_posts(posts(spark, rows))
    v = T.trend_velocity(p).first()
    assert (v.slope, v.r2, v.n_weeks) == (0.0, 0.0, 2)
    assert T.forecast(p).count() == 0


def test_constant_series_r2_zero(spark):
    rows = [row(i, ts=dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i), er=0.2) for i in range(5)]
    v = T.trend_velocity(ingest_posts(posts(spark, rows))).first()
    assert v.r2 == 0.0 and v.slope == 0.0


def test_iso_week_year(spark):
    df = posts(spark, [row(1, ts=dt.datetime(2024, 12, 30, 10))])
    iso = ingest_posts(df).first()
    cal = ingest_posts(df, year_mode="calendar").first()
    assert (iso.week, iso.year, cal.year, iso.day_num, iso.day) == (1, 2025, 2024, 0, "Monday")


def test_parse_count_cases(spark):
    df = spark.createDataFrame([("1,234 likes",), ("1.2K",), ("3.5M",), ("N/A",), ("",), (None,),
                                ("--",), ("abc",)], "t string")
    got = [r.n for r in df.select(TX.parse_count("t").alias("n")).collect()]
    assert got == [1234, 1200, 3500000, 0, 0, 0, 0, 0]


def test_substring_matching_counts_both(spark):
    df = spark.createDataFrame([("i failed",)], "t string")
    assert df.select(TX.hit_count("t", TX.STRUGGLE_WORDS).alias("n")).first().n == 2
    # 2 struggle hits (fail, failed) → min(30, 40) = 30
    assert df.select(TX.relatability_score("t").alias("s")).first().s == 30.0


def test_null_group_key_absent(spark):
    rows = [row(1, cat=None), row(2, cat="A")]
    got = [r.content_category for r in X.mean_by_key(posts(spark, rows), keys="content_category").collect()]
    assert got == ["A"]


def test_t_distribution_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (2.776445, 4.0), (1.96, 100000.0)], "t double, nu double")
    got = [r.p for r in df.select(S.t_two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect()]
    assert abs(got[0] - 0.0733880) < 1e-6 and abs(got[1] - 0.05) < 1e-6 and abs(got[2] - 0.0499986) < 1e-6
    q = spark.range(1).select(S.t_quantile(0.975, F.lit(4.0)).alias("q")).first().q
    assert abs(q - 2.7764451) < 1e-6


def test_ab_swap_changes_sign_keeps_p(spark):
    rows = ([row(i, media="reel", er=0.05 + (i % 7) / 100) for i in range(12)]
            + [row(100 + i, media="image", er=0.04 + (i % 5) / 100) for i in range(9)])
    df = posts(spark, rows)
    a = A.ab_test(df, variable="media_type", a="reel", b="image").first()
    b = A.ab_test(df, variable="media_type", a="image", b="reel").first()
    assert abs(a.t_stat + b.t_stat) < 1e-12 and abs(a.cohens_d + b.cohens_d) < 1e-12
    assert abs(a.p_value - b.p_value) < 1e-12


def test_ab_insufficient_group(spark):
    df = posts(spark, [row(i, media="reel") for i in range(6)] + [row(9, media="image")])
    r = A.ab_test(df, variable="media_type", a="reel", b="image").first()
    assert r.significant is False and r.error.startswith("Insufficient data: Group A n=6, Group B n=1")


def test_awareness_levels(spark):
    df = spark.createDataFrame([("a", "the system and society"), ("b", "me too, same here"),
                                ("c", "i was sad and my day"), ("c", "i felt it")], "content_category string, comment_text string")
    got = {r.content_category: r.problem_awareness for r in TO.problem_awareness(df).collect()}
    assert got == {"a": "Systemic", "b": "Shared", "c": "Personal"}


def test_repartition_invariance(spark):
    rows = [row(i, cat="ABC"[i % 3], likes=i, saves=i % 5, shares=i % 4, er=(i % 11) / 100) for i in range(60)]
    base = posts(spark, rows)
    res = []
    for n in (1, 7, 16):
        v = N.viral_coefficients(base.repartition(n))
        res.append(sorted((r.post_id, round(r.vc_percentile, 9), r.vc_tier) for r in v.collect()))
    assert res[0] == res[1] == res[2]


def test_percent_rank_range_and_tier_counts(spark):
    rows = [row(i, likes=i % 13, saves=i % 7, shares=i % 3, reach=100 + i % 17, er=(i % 19) / 100)
            for i in range(200)]
    v = N.viral_coefficients(N.performance_tiers(posts(spark, rows)))
    got = v.agg(F.min("vc_percentile").alias("lo"), F.max("vc_percentile").alias("hi"),
                F.count("vc_tier").alias("n_vc"), F.count("tier").alias("n_t")).first()
    assert 0 < got.lo and got.hi == 100.0 and got.n_vc == 200 and got.n_t == 200


def test_multi_bucket_ranks_equal_single_bucket(spark):
    df = spark.createDataFrame([(float((i * 7919) % 503) / 7,) for i in range(3000)], "v double")
    one = O.value_ranks(df, "v", ranges=1).orderBy("v").collect()
    many = O.value_ranks(df, "v", ranges=13).orderBy("v").collect()
    assert one == many


def test_row_order_irrelevant(spark):
    rows = [row(i, cat="ABC"[i % 3], likes=i, er=(i % 11) / 100) for i in range(40)]
    a = X.topic_viral_ranking(N.viral_coefficients(posts(spark, rows), percentile=False, tiers=False))
    b = X.topic_viral_ranking(N.viral_coefficients(posts(spark, list(reversed(rows))).repartition(5),
                                                   percentile=False, tiers=False))
    def rounded(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(a) == rounded(b)   # float sums may differ in the last bit with order


def test_forecast_unknown_category_uses_all_rows(spark):
    rows = [row(i, cat="AB"[i % 2], ts=dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * (i // 2)),
                er=0.1 + (i % 5) / 100) for i in range(20)]
    p = ingest_posts(posts(spark, rows))
    f = T.forecast(p, only="nope")
    cats = {r.content_category for r in f.select("content_category").distinct().collect()}
    assert cats == {"ALL"}
    assert f.where("type = 'forecast'").count() == 14
    assert f.where("type = 'forecast' AND forecast < 0").count() == 0


def test_legacy_calendar_year_pairs_iso_week_with_calendar_year(spark):
    df = posts(spark, [row(1, ts=dt.datetime(2024, 12, 30)), row(2, ts=dt.datetime(2024, 1, 2))])
    keys = sorted(r.k for r in ingest_posts(df, year_mode="calendar")
                  .select(C.week_key().alias("k")).collect())
    assert keys == ["2024-W01", "2024-W01"]


def test_new_only_null_key_seen_once_present(spark):
    from postlens.operators.combine import new_only
    new = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "link string")
    pool_with_null = spark.createDataFrame([("a",), (None,)], "link string")
    pool_without = spark.createDataFrame([("a",)], "link string")
    assert sorted(r.link for r in new_only(new, pool_with_null).collect()) == ["b", "b"]
    got = sorted((r.link or "") for r in new_only(new, pool_without).collect())
    assert got == ["", "b", "b"]   # batch duplicates kept; null unseen


def test_text_helpers_edge_cases(spark):
    df = spark.createDataFrame([("Café day #café #run_2 @josé @a hi", "x"),
                                ("gym and food tips", ""), ("nothing here", "Travel vlog"),
                                (None, None)], "caption string, tag string")
    got = df.select(TX.count_hashtags("caption").alias("h"), TX.count_mentions("caption").alias("m"),
                    TX.classify_topic("caption", "tag").alias("t"),
                    TX.detect_cta("caption").alias("c")).collect()
    assert [(r.h, r.m) for r in got] == [(2, 2), (0, 0), (0, 0), (0, 0)]
    assert [r.t for r in got] == ["Technology", "Fitness", "Travel", "Technology"]
    assert [r.c for r in got] == [0, 0, 0, 0]
    cta = spark.createDataFrame([("Link in BIO now",)], "caption string")
    assert cta.select(TX.detect_cta("caption").alias("c")).first().c == 1


def test_clock_labels_and_bands(spark):
    df = spark.createDataFrame([(0,), (9,), (12,), (13,), (23,)], "hour int")
    got = [(r.a, r.b) for r in df.select(C.clock_label("hour").alias("a"),
                                         C.clock_label("hour", padded=True).alias("b")).collect()]
    assert got == [("12:00 AM", "12:00 AM"), ("9:00 AM", "09:00 AM"), ("12:00 PM", "12:00 PM"),
                   ("1:00 PM", "01:00 PM"), ("11:00 PM", "11:00 PM")]
    rates = spark.createDataFrame([(0.08,), (0.0799,), (0.05,), (0.03,), (0.01,), (0.0,)], "r double")
    bands = [r.b for r in rates.select(C.engagement_band("r").alias("b")).collect()]
    assert bands == ["VIRAL", "HIGH", "HIGH", "MEDIUM", "LOW", "VERY LOW"]
    hg = [r.g for r in df.select(C.hour_group("hour").alias("g")).collect()]
    assert hg == ["off_peak", "morning_peak", "off_peak", "off_peak", "off_peak"]


def test_split_tags_and_post_kind(spark):
    df = spark.createDataFrame([(" #fitness, gym ,, ##food ,", "https://x.invalid/reel/1/")],
                               "t string, link string")
    r = df.select(TX.split_tags("t").alias("s"), TX.post_kind("link").alias("k"),
                  TX.is_post_link("link").alias("p")).first()
    assert r.s == ["fitness", "gym", "food"] and r.k == "reel" and r.p


def test_page_fields_search_a_page_once_per_field(spark):
    """Every pattern is searched for once per page, whatever uses its value has; a count that
    is no number, an empty and a null page keep their values."""
    from postlens.operators import scoring as M
    from postlens.operators import textops as TO
    rows = [("a", '<a rel="author" href="/u">@ann_1</a><p>1,234 likes</p><p>3.5M views</p>'
                  '<time class="t" datetime="2024-12-30T13:05:00Z">x</time>'),
            ("b", "<p>.,. likes</p><p>2 K comments</p><time datetime=\"soon\">"), ("c", ""), ("d", None)]
    df = spark.createDataFrame(rows, "post_id string, html string")
    out = M.post_time_fields(TO.page_fields(df))
    assert out.columns == ["post_id", "html", *TO.PAGE_PATTERNS, "hour", "day_num", "month_num", "week"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for p in [*TO.PAGE_PATTERNS.values(), "(Z|[+-]"]:
        assert plan.count(p) == 1, p
    got = {r.post_id: tuple(r)[2:] for r in out.collect()}
    assert got["a"] == (1234, None, 3500000, "2024-12-30T13:05:00Z", "ann_1", 13, 0, 12, 1)
    assert got["b"] == (0, 2000, None, "soon", None, 9, 1, 4, 16)
    assert got["c"] == got["d"] == (None, None, None, None, None, 9, 1, 4, 16)
