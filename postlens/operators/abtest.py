"""A/B testing (H1-H8): Welch's t-test, Cohen's d, confidence intervals.

All tests of a call share one scan: the variables are unpivoted to
(variable, value) pairs and one aggregate yields n / mean / sample std for
every group (partial aggregation, so hot groups are pre-combined per task).
The statistics are then expressions over the few aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.functions import stats as S

METRIC = "engagement_rate"
MIN_N = 5
PAIR_BLOCKS = 16
# What a custom experiment can choose.
ALL_VARIABLES = ("media_type", "content_category", "account_type", "has_call_to_action", "hour")
ALL_METRICS = ("engagement_rate", "likes", "shares", "saves")

# Fixed value: the default test battery (variable, group A, group B).
DEFAULT_TESTS = (
    ("media_type", "reel", "image"),
    ("media_type", "reel", "carousel"),
    ("media_type", "image", "carousel"),
    ("has_call_to_action", "1", "0"),
    ("_hour_group", "morning_peak", "evening_peak"),
    ("_hour_group", "morning_peak", "off_peak"),
)


def group_moments(df: DataFrame, *, variables: Sequence[str], metric: str = METRIC,
                  materialize: bool = True) -> DataFrame:
    """H1: n, mean, sample std of ``metric`` per (variable, value-as-string).

    Both sides of every test read these moments; they are one row per group,
    so they are written once and the facts are scanned once."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"))
        for v in variables])).alias("p")
    mom = (df.where(F.col(metric).isNotNull())
           .select(pairs, F.col(metric).alias("m"))
           .select("p.variable", "p.value", "m")
           .where(F.col("value").isNotNull())
           .groupBy("variable", "value")
           .agg(F.count("m").alias("n"), F.avg("m").alias("mean"),
                F.stddev_samp("m").alias("std")))
    if materialize:
        from postlens.operators.orderstats import materialized
        mom = materialized(mom)
    return mom


def _stats(ma, sa, na, mb, sb, nb, alpha: float) -> dict[str, Column]:
    va, vb = sa * sa, sb * sb
    ea, eb = F.try_divide(va, na.cast("double")), F.try_divide(vb, nb.cast("double"))
    se2 = ea + eb
    # two constant groups: an infinite t (p = 0) if their means differ, else no t at all
    flat = se2 == 0
    t = (F.when(~flat, F.try_divide(ma - mb, F.sqrt(se2)))
         .when(ma > mb, F.lit(float("inf"))).when(ma < mb, F.lit(float("-inf"))))
    dof = F.when(flat, F.lit(1.0)).otherwise(
        F.try_divide(se2 * se2, F.try_divide(ea * ea, na - 1) + F.try_divide(eb * eb, nb - 1)))
    p = F.when(flat, F.when(ma != mb, F.lit(0.0))).otherwise(S.t_two_sided_p(t, dof))
    pooled = F.sqrt(F.try_divide((na - 1) * va + (nb - 1) * vb, na + nb - 2))
    d = F.when((na < 2) | (nb < 2), F.lit(0.0)).when(pooled > 0, (ma - mb) / pooled).otherwise(F.lit(0.0))
    lift = F.abs(ma - mb) / F.greatest(F.least(ma, mb), F.lit(1e-9)) * 100
    return {"t_stat": t, "dof": dof, "p_value": p, "cohens_d": d,
            "effect_label": S.effect_label(d), "significant": F.coalesce(p < alpha, F.lit(False)), "lift_pct": lift}


def _ci(mean, std, n, conf: float = 0.95):
    h = F.try_divide(std, F.sqrt(n.cast("double"))) * S.t_quantile((1 + conf) / 2, n - 1)
    lo = F.when(n < 2, mean).otherwise(mean - h)
    hi = F.when(n < 2, mean).otherwise(mean + h)
    return lo, hi


def _paired(mom: DataFrame, tests: DataFrame) -> DataFrame:
    a = mom.select(F.col("variable"), F.col("value").alias("group_a"), F.col("n").alias("n_a"),
                   F.col("mean").alias("mean_a"), F.col("std").alias("std_a"))
    b = mom.select(F.col("variable"), F.col("value").alias("group_b"), F.col("n").alias("n_b"),
                   F.col("mean").alias("mean_b"), F.col("std").alias("std_b"))
    return (tests.join(a, ["variable", "group_a"], "left").join(b, ["variable", "group_b"], "left")
            .fillna(0, subset=["n_a", "n_b"]))


def _tests_frame(df: DataFrame, tests: Sequence[tuple]) -> DataFrame:
    rows = [(i, v, str(a), str(b)) for i, (v, a, b) in enumerate(tests)]
    return df.sparkSession.createDataFrame(
        rows, "test_no int, variable string, group_a string, group_b string")


def _with_hour_group(df: DataFrame, hour: str = "hour") -> DataFrame:
    return df.withColumn("_hour_group", C.hour_group(hour)) if hour in df.columns else df


def ab_test(df: DataFrame, *, variable: str, a, b, metric: str = METRIC,
            alpha: float = 0.05, conf: float = 0.95) -> DataFrame:
    """H6: full report for one comparison as a one-row DataFrame.

    Groups with fewer than 5 rows give a row with ``error`` set and
    ``significant`` false, as the reference returns an error record.
    """
    return ab_pairs(df, variable=variable, pairs=[(a, b)], metric=metric, alpha=alpha,
                    conf=conf).drop("test_no")


def ab_pairs(df: DataFrame, *, variable: str, pairs: Sequence[tuple], metric: str = METRIC,
             alpha: float = 0.05, conf: float = 0.95) -> DataFrame:
    """H6/H8: chosen (A, B) pairs of one variable, one scan for all of them."""
    mom = group_moments(df, variables=[variable], metric=metric)
    tests = _tests_frame(df, [(variable, a, b) for a, b in pairs])
    return _report(_paired(mom, tests).withColumn("metric", F.lit(metric)), ["test_no"], alpha, conf)


def ab_all_pairs(df: DataFrame, *, variables: Sequence[str] = ALL_VARIABLES, metrics: Sequence[str] = ALL_METRICS,
                 alpha: float = 0.05, conf: float = 0.95) -> DataFrame:
    """H8: every pair of values (group_a < group_b, as strings) of each variable, for each
    metric.  The facts are scanned once; the pairs are a theta self-join of the moments.  One
    side of it is dealt into ``PAIR_BLOCKS`` blocks, so a variable of many values isn't one task."""
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables]))
    facts = df.select(cells.alias("p"), F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("m"))
                                                  for m in metrics]).alias("ms"))
    facts = facts.where("p.value is not null").select("p.*", F.explode("ms").alias("x")).select("variable", "value", "x.*")
    from postlens.operators.orderstats import materialized
    mom = materialized(facts.where("m is not null").groupBy("variable", "metric", "value").agg(
        F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")))
    key = ["variable", "metric", "block"]
    side = lambda x: [F.col(c).alias(f"{'group' if c == 'value' else c}_{x}") for c in ("value", "n", "mean", "std")]
    a = mom.select("variable", "metric", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))).alias("block"), *side("a"))
    b = mom.select("variable", "metric", F.pmod(F.xxhash64("value"), F.lit(PAIR_BLOCKS)).alias("block"), *side("b"))
    pairs = a.join(b, key).where(F.col("group_a") < F.col("group_b")).drop("block")
    return _report(pairs, [], alpha, conf)


def _report(j: DataFrame, head: list[str], alpha: float, conf: float) -> DataFrame:
    """H6 for every row of both sides' moments; under 5 rows on a side: ``error`` only."""
    s = _stats(F.col("mean_a"), F.col("std_a"), F.col("n_a"), F.col("mean_b"), F.col("std_b"),
               F.col("n_b"), alpha)
    ok = (F.col("n_a") >= MIN_N) & (F.col("n_b") >= MIN_N)
    ci_a = _ci(F.col("mean_a"), F.col("std_a"), F.col("n_a"), conf)
    ci_b = _ci(F.col("mean_b"), F.col("std_b"), F.col("n_b"), conf)
    winner = F.when(F.col("mean_a") > F.col("mean_b"), F.col("group_a")).otherwise(F.col("group_b"))
    loser = F.when(F.col("mean_a") > F.col("mean_b"), F.col("group_b")).otherwise(F.col("group_a"))
    body = j.select(*head, "variable", "group_a", "group_b", "metric",
                    "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b",
                    ci_a[0].alias("ci_a_lo"), ci_a[1].alias("ci_a_hi"),
                    ci_b[0].alias("ci_b_lo"), ci_b[1].alias("ci_b_hi"),
                    *[v.alias(k) for k, v in s.items()],
                    F.lit(alpha).alias("alpha"), winner.alias("winner"), loser.alias("_loser"))
    interp = F.when(
        F.col("significant"),
        F.format_string("✅ Statistically significant (p=%.4f < α=%s). **%s** outperforms %s "
                        "by %.1f%% with a %s effect size.", F.col("p_value"),
                        F.col("alpha").cast("string"), F.col("winner"), F.col("_loser"),
                        F.col("lift_pct"), F.lower("effect_label"))
    ).otherwise(
        F.format_string("❌ Not statistically significant (p=%.4f ≥ α=%s). The %.1f%% difference "
                        "between %s and %s could be due to chance — collect more data.",
                        F.coalesce("p_value", F.lit(float("nan"))), F.col("alpha").cast("string"), F.col("lift_pct"),
                        F.col("group_a"), F.col("group_b")))
    err = F.format_string("Insufficient data: Group A n=%d, Group B n=%d. Need ≥5 each.",
                          F.col("n_a"), F.col("n_b"))
    out = body.withColumn("interpretation", interp).drop("_loser")
    stat_cols = [c for c in out.columns if c not in ("test_no", "variable", "group_a", "group_b",
                                                     "metric", "n_a", "n_b", "significant")]
    return out.select(
        *head, "variable", "group_a", "group_b", "metric", "n_a", "n_b",
        *[F.when(ok, F.col(c)).alias(c) for c in stat_cols],
        F.when(ok, F.col("significant")).otherwise(F.lit(False)).alias("significant"),
        F.when(ok, F.lit(None).cast("string")).otherwise(err).alias("error"))


def ab_battery(df: DataFrame, *, tests: Sequence[tuple] = DEFAULT_TESTS, metric: str = METRIC,
               alpha: float = 0.05) -> DataFrame:
    """H7: the predefined tests in one scan; missing variables and groups under
    5 rows are skipped; rounded summary table."""
    src = _with_hour_group(df)
    tests = [t for t in tests if t[0] in src.columns]
    variables = sorted({t[0] for t in tests})
    mom = group_moments(src, variables=variables, metric=metric)
    j = _paired(mom, _tests_frame(df, tests)).where(
        (F.col("n_a") >= MIN_N) & (F.col("n_b") >= MIN_N))
    s = _stats(F.col("mean_a"), F.col("std_a"), F.col("n_a"), F.col("mean_b"), F.col("std_b"),
               F.col("n_b"), alpha)
    winner = F.when(F.col("mean_a") > F.col("mean_b"), F.col("group_a")).otherwise(F.col("group_b"))
    return j.select(
        "test_no",
        F.concat(F.col("variable"), F.lit(": "), F.col("group_a"), F.lit(" vs "),
                 F.col("group_b")).alias("test"),
        winner.alias("winner"),
        F.round(s["lift_pct"], 1).alias("lift_pct"),
        F.round(s["p_value"], 4).alias("p_value"),
        F.when(s["significant"], "✅ Yes").otherwise("❌ No").alias("significant"),
        s["effect_label"].alias("effect_size"),
        F.round(s["cohens_d"], 3).alias("cohens_d"),
        "n_a", "n_b")
