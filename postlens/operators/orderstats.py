"""Exact order statistics without a single-task step over rows or values.

``value_ranks`` turns a column into one row per distinct value with the number
of rows below it.  A hot value is one row after the first aggregation.  The
distinct values are always range-partitioned by Spark's own sampled bounds into
ranges of about ``PER_RANGE`` values, whatever their number; the running count is
a window inside each range, and only the range totals (one row per range) are
summed up globally.

The same ranking can be keyed: many columns at once (D17), or the rows of a
label by a hash (K8), share one count and one ranking.

On top of it:
* ``exact_quantiles`` — pandas/numpy ``linear`` quantiles, exact, as one row;
* ``keyed_quantiles`` — one quantile of many columns from one ranking;
* ``avg_percent_rank`` — ``rank(pct=True)`` with average ranks for ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.scalars import scalar_struct
from postlens.session import stage_path

PER_RANGE = 200_000        # distinct values that one window task ranks, about


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: one pass (a reliable ``checkpoint()`` computes its input twice),
    lineage cut, and the files survive the loss of any executor."""
    path = stage_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def value_ranks(df: DataFrame, col: str, *, ranges: int | None = None) -> DataFrame:
    """Columns: v, cnt, less (rows with a smaller value), n (all non-null rows).

    The ranks feed several consumers (quantile filters, joins), so they are
    written once: the facts are aggregated once, not once per consumer."""
    counts = (df.select(F.col(col).alias("v")).where(F.col("v").isNotNull())
              .groupBy("v").agg(F.count(F.lit(1)).alias("cnt")))
    return materialized(ranks_from_counts(counts, ranges=ranges))


def ranks_from_counts(counts: DataFrame, *, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(keys…, v, cnt) → (keys…, v, cnt, less, n), ranked within each key.

    The counts are dealt by ranges of (keys, v) and written with the number of
    their range; so the totals per range and the windows inside the ranges see
    the same ranges, however often they are computed."""
    keys = list(keys)
    counts = materialized(counts)
    n = ranges or max(2, -(-counts.count() // PER_RANGE))
    dealt = materialized(counts.repartitionByRange(n, *keys, "v").withColumn("range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "range").agg(F.sum("cnt").alias("tot"))
    by_range = Window.partitionBy(*keys).orderBy("range")        # one row per range (and key)
    offsets = totals.select(
        *keys, "range",
        F.coalesce(F.sum("tot").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("tot").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.withColumn("upto", F.sum("cnt").over(inside)).join(offsets, [*keys, "range"])
            .select(*keys, "v", "cnt", (F.col("offset") + F.col("upto") - F.col("cnt")).alias("less"), "n"))


def _lerp(a, b, t):
    # numpy's linear interpolation, including its t >= 0.5 form
    return F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def exact_quantiles(df: DataFrame | None, col: str, probs: Sequence[float], *,
                    ranks: DataFrame | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row, one double column per prob (``q0, q1, …`` or ``names``).

    The ≤ 2 rows per prob that hold the order statistics at floor/ceil((n-1)·p)
    are found with a filter over the distinct-value table and combined in one
    global aggregate (no join).
    Empty input gives one row of nulls."""
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    r = ranks if ranks is not None else value_ranks(df, col)
    rr = r.withColumn("__n", F.col("n"))          # every rank row carries the total
    less, cnt, v = F.col("less"), F.col("cnt"), F.col("v").cast("double")
    any_hit, aggs = F.lit(False), []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * float(p)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("__n") - 1)
        hit_lo = (less <= lo) & (lo < less + cnt)
        hit_hi = (less <= hi) & (hi < less + cnt)
        any_hit = any_hit | hit_lo | hit_hi
        aggs += [F.max(F.when(hit_lo, v)).alias(f"__a{i}"), F.max(F.when(hit_hi, v)).alias(f"__b{i}"),
                 F.max(h - lo).alias(f"__f{i}")]
    picked = rr.where(any_hit).agg(*aggs)
    return picked.select(*[_lerp(F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__f{i}")).alias(nm)
                           for i, nm in enumerate(names)])


def avg_percent_rank(df: DataFrame, col: str, out: str, *,
                     ranks: DataFrame | None = None) -> DataFrame:
    """``(less + (ties + 1) / 2) / n * 100``; null values get null."""
    r = ranks if ranks is not None else value_ranks(df, col)
    pr = r.select(F.col("v").alias("__v"),
                  ((F.col("less") + (F.col("cnt") + 1) / 2) / F.col("n") * 100).alias(out))
    return df.join(pr, F.col(col) == F.col("__v"), "left").drop("__v")


def tier_by_quantile(df: DataFrame, *, metric: str, probs: Sequence[float],
                     labels: Sequence[str], out: str,
                     reference_df: DataFrame | None = None) -> DataFrame:
    """Label rows by quantiles of ``metric`` over ``reference_df``
    (default: ``df`` itself), ``>=`` at each bound."""
    from postlens.functions.columns import tier_from_bounds
    ref = reference_df if reference_df is not None else df
    names = [f"q{i}" for i in range(len(probs))]
    qs = scalar_struct(exact_quantiles(ref, metric, probs, names=names))   # computed once
    return (df.withColumn("__q", qs)
            .withColumn(out, tier_from_bounds(metric, [F.col("__q")[n] for n in names], labels))
            .drop("__q"))


def keyed_quantiles(df: DataFrame, cols: Sequence[str], prob: float) -> DataFrame:
    """One row: the exact ``prob`` quantile of each column (named as the column).

    One pass over the facts counts every (column, value) pair, one ranking keyed
    by the column ranks them all, and one aggregate picks the order statistics."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))
                                for c in cols])).alias("s")
    counts = (df.select(pairs).select("s.k", "s.v").where(F.col("v").isNotNull())
              .groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt")))
    h = (F.col("n") - 1) * float(prob)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("n") - 1)
    holds = lambda at: (F.col("less") <= at) & (at < F.col("less") + F.col("cnt"))
    picked = (ranks_from_counts(counts, keys=["k"]).where(holds(lo) | holds(hi)).groupBy("k")
              .agg(F.max(F.when(holds(lo), F.col("v"))).alias("a"), F.max(F.when(holds(hi), F.col("v"))).alias("b"),
                   F.max(h - lo).alias("f"))
              .select("k", _lerp(F.col("a"), F.col("b"), F.col("f")).alias("q")))
    return picked.agg(*[F.max(F.when(F.col("k") == c, F.col("q"))).alias(c) for c in cols])
