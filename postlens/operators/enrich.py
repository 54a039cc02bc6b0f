"""Row enrichment: viral coefficients, tiers, caps, presentation helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.functions.scalars import scalar, scalar_struct
from postlens.operators import orderstats as O

# Fixed value: the 23 non-feature columns dropped before model training.
MODEL_DROP = (
    "post_id", "account_id", "post_datetime", "post_date",
    "performance_bucket_label", "day", "month",
    "viral_score", "save_to_share",
    "tier", "vc_raw", "vc_percentile", "vc_tier", "high_value_ratio",
    "year", "week", "link", "username", "caption",
    "at_mentions", "views", "comments_count", "scraped_ok",
)


def performance_tiers(df: DataFrame, *, metric: str = "engagement_rate", out: str = "tier",
                      reference_df: DataFrame | None = None) -> DataFrame:
    """Low/Medium/High/Viral by quartiles of ``metric`` over the whole table."""
    return O.tier_by_quantile(df, metric=metric, probs=C.PERF_TIER_PROBS,
                              labels=C.PERF_TIER_LABELS, out=out, reference_df=reference_df)


def viral_coefficients(df: DataFrame, *, saves="saves", shares="shares", likes="likes",
                       comments="comments", reach="reach", weights=C.VC_WEIGHTS,
                       ranges: int | None = None, percentile: bool = True,
                       tiers: bool = True) -> DataFrame:
    """vc_raw, high_value_ratio, vc_percentile (average ties), vc_tier.

    Percentile and tier bounds both come from one distinct-value rank table of
    vc_raw (one aggregation, reused by both consumers).
    """
    cols = df.columns
    base = df.withColumns({
        "vc_raw": C.viral_coefficient(cols, saves=saves, shares=shares, comments=comments,
                                      reach=reach, weights=weights),
        "high_value_ratio": C.high_value_ratio(cols, saves=saves, shares=shares,
                                               likes=likes, comments=comments),
    })
    if not (percentile or tiers):
        return base
    ranks = O.value_ranks(base, "vc_raw", ranges=ranges)
    out = O.avg_percent_rank(base, "vc_raw", "vc_percentile", ranks=ranks) if percentile else base
    if not tiers:
        return out
    names = ["p50", "p80", "p95"]
    qs = scalar_struct(O.exact_quantiles(base, "vc_raw", C.VC_TIER_PROBS, ranks=ranks, names=names))
    return (out.withColumn("__q", qs)
            .withColumn("vc_tier", C.tier_from_bounds("vc_raw", [F.col("__q")[n] for n in names],
                                                      C.VC_TIER_LABELS))
            .drop("__q"))


def cap_at_quantile(df: DataFrame, *, col: str, q: float = 0.99, out: str | None = None) -> DataFrame:
    """Clip ``col`` above its exact ``q`` quantile."""
    cap = scalar(O.exact_quantiles(df, col, [q], names=["cap"]))
    return df.withColumn(out or col, F.least(F.col(col), cap))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each missing column as a constant."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def model_columns(df: DataFrame, drop: Iterable[str] = MODEL_DROP) -> DataFrame:
    """Drop the non-feature columns, ignoring absent ones."""
    return df.drop(*[c for c in drop if c in df.columns])


def present_table(df: DataFrame, *, columns: Sequence[str], order_by: Sequence,
                  rename: Mapping[str, str] | None = None, digits: int = 4,
                  limit: int = 500) -> DataFrame:
    """Existing columns only, doubles rounded, renamed, first ``limit`` rows
    of an explicit order (TakeOrderedAndProject, not a full sort)."""
    keep = [c for c in columns if c in df.columns]
    types = dict(df.dtypes)
    sel = [F.round(c, digits).alias(c) if types[c] in ("double", "float") else F.col(c)
           for c in keep]
    out = df.orderBy(*order_by).limit(limit).select(*sel)
    return out.withColumnsRenamed(dict(rename)) if rename else out


def run_deltas(log: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """Run number and change of MAE / R² against the previous run.

    The log has one row per training run (small), so an unpartitioned window
    is acceptable here.
    """
    w = Window.orderBy(ts)
    return log.select(
        "*",
        F.row_number().over(w).alias("run"),
        (F.col("mae") - F.lag("mae").over(w)).alias("mae_delta"),
        (F.col("r2") - F.lag("r2").over(w)).alias("r2_delta"),
        (F.col("mae") < F.lag("mae").over(w)).alias("mae_improved"),
        (F.col("r2") > F.lag("r2").over(w)).alias("r2_improved"),
    )
