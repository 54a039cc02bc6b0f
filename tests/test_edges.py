"""Edge rows of the operators: constant groups and labels, groups without a metric,
absent columns, files with other headers, null texts, clusters without a shared folder."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from postlens import session as SE
from postlens.functions import stats as ST
from postlens.operators import abtest as A
from postlens.operators import explore as X
from postlens.operators import learn as K
from postlens.operators import orderstats as O
from postlens.operators import scoring as M
from postlens.plans.q_core import posts
from postlens.sources.posts import scan_posts
from tests.conftest import SF_SMALL


def _two_groups(spark, a, b):
    rows = [("x", v) for v in a] + [("y", v) for v in b]
    return spark.createDataFrame(rows, "media_type string, engagement_rate double")


def test_ab_test_of_constant_groups(spark):
    r = A.ab_test(_two_groups(spark, [2.0] * 6, [1.0] * 6), variable="media_type", a="x", b="y").first()
    assert r.t_stat == math.inf and r.p_value == 0 and r.significant and r.winner == "x"
    r = A.ab_test(_two_groups(spark, [1.0] * 6, [1.0] * 6), variable="media_type", a="x", b="y").first()
    assert r.t_stat is None and r.p_value is None and r.significant is False and r.error is None
    r = A.ab_test(_two_groups(spark, [1.0], [2.0]), variable="media_type", a="x", b="y").first()
    assert r.error.startswith("Insufficient data") and r.significant is False


def test_ab_battery_survives_a_constant_group(spark):
    df = _two_groups(spark, [2.0] * 6, [1.0] * 6)
    assert A.ab_battery(df, tests=[("media_type", "x", "y")]).count() == 1


def test_metrics_of_a_constant_label(spark):
    exact = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "engagement_rate double, prediction double")
    assert K.regression_metrics(exact).first().r2 == 1.0
    off = spark.createDataFrame([(1.0, 1.5), (1.0, 1.0)], "engagement_rate double, prediction double")
    assert K.regression_metrics(off).first().r2 == 0.0
    assert K.regression_metrics(off.limit(0)).first().r2 is None


def test_a_group_without_a_metric_never_wins(spark):
    df = spark.createDataFrame([("x", "r", 1, None), ("y", "r", 2, 0.5), ("y", "s", 3, None)],
                               "content_category string, media_type string, hour int, engagement_rate double")
    got = {r.key_name: (r.best_value, r.best_avg) for r in X.best_key(df, keys=["content_category", "media_type"]).collect()}
    assert got == {"content_category": ("y", 0.5), "media_type": ("r", 0.5)}
    top = X.suggested_topics(df).collect()
    assert [(r.content_category, r.best_media_type, r.best_hour) for r in top] == [("y", "r", 2)]
    vc = spark.createDataFrame([("x", None, None), ("y", 0.5, "Mega-Viral")], "content_category string, vc_raw double, vc_tier string")
    assert X.virality_kpis(vc).first().top_category == "y"
    flags = X.cta_impact(spark.createDataFrame([(0, None), (1, 0.2), (2, 0.2)], "has_call_to_action int, engagement_rate double"))
    assert {r.has_call_to_action: r.is_best for r in flags.collect()} == {0: False, 1: True, 2: False}


def test_any_null_form_of_require_metric(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (2.0, None)], "engagement_rate double, media_type string")
    assert X.require_metric(df).count() == 2
    assert X.require_metric(df, None).count() == 1


def test_absent_columns_take_the_defaults(spark):
    defaults = M.column_defaults(posts(spark, SF_SMALL)).withColumn("follower_count", F.lit(100.0))
    row = M.feature_rows(spark.createDataFrame([("l", 1000)], "link string, likes bigint"), defaults).first()
    assert row.reach == 100 and row.follower_count == 100 and row.media_type == "reel"


def test_csv_files_with_other_headers_are_refused(spark):
    path = f"{SE.checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    spark.createDataFrame([(1, 2, 0.1)], "likes int, shares int, engagement_rate double").write.option("header", True).csv(f"{path}")
    assert scan_posts(spark, path).select("likes", "shares").first() == (1, 2)
    (spark.createDataFrame([(20, 10, 0.1)], "shares int, likes int, engagement_rate double")
     .write.mode("append").option("header", True).csv(path))
    with pytest.raises(Exception, match="(?i)header"):
        scan_posts(spark, path).collect()


def test_folds_are_stratified_and_keep_null_texts(spark):
    rows = [(f"t{i}", "a" if i % 4 else "b") for i in range(80)] + [(None, "a"), ("same", "b"), ("same", "b")]
    out = K.with_folds(spark.createDataFrame(rows, "text string, label string"), label="label", id_col="text")
    assert out.count() == len(rows)
    n = {(r.label, r.fold): r.n for r in out.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n[lab, f] - sum(n[lab, g] for g in range(3)) / 3) <= 2 for lab in "ab" for f in range(3))


def test_t_quantile_beyond_the_first_bound(spark):
    q = spark.range(1).select(ST.t_quantile(0.9995, F.lit(1.0)).alias("q")).first().q
    assert abs(q - 636.619) < 0.01                       # the tabled value


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://h:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="shared folder"):
        SE.checkpoint_dir(Session())


def test_stages_can_be_cleared(spark):
    df = O.materialized(spark.range(3))
    assert df.count() == 3 and SE.clear_stages(spark) >= 1
    assert SE.clear_stages(spark) == 0


def test_fields_stated_on_a_page(spark):
    from postlens.operators import textops as TO
    page = ('<a rel="author" href="/u">@ann_b</a> 1.2K likes, 1,234 comments <b>3M</b> 15 views'
            '<time class="x" datetime="2024-05-06T07:08:09">ago</time>')
    r = TO.page_fields(spark.createDataFrame([(page,), ("",), (None,)], "html string")).collect()
    assert tuple(r[0])[1:] == (1200, 1234, 15, "2024-05-06T07:08:09", "ann_b")
    assert all(v is None for row in r[1:] for v in tuple(row)[1:])


@pytest.fixture
def written_plans(monkeypatch):
    """The plans of the stages that a query writes while it is built."""
    plans, write = [], O.materialized

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)
    monkeypatch.setattr(O, "materialized", spy)
    return plans


@pytest.mark.parametrize("name", ["viral_coefficient", "column_defaults", "scored_lookup", "value_histogram"])
def test_windows_over_values_are_partitioned(spark, written_plans, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    plans = [*written_plans, df._jdf.queryExecution().optimizedPlan().toString()]
    windows = [line for p in plans for line in p.splitlines() if "Window [" in line]
    assert windows and any("RepartitionByExpression" in p for p in plans)
    for line in windows:
        # over the whole frame only the totals of the ranges are summed
        assert "sum(cnt" not in line or "range#" in line.split("windowspecdefinition(")[1], line
        assert "percentile" not in line and "rank" not in line


def test_date_bounds_reach_the_scan(spark):
    import __spark_entry__ as E
    for name in ("facet_filter", "page_filter"):
        p = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        pushed = p.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(l_shipdate" in pushed or "GreaterThan(l_shipdate" in pushed, (name, pushed)
