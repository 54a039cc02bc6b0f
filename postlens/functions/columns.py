"""Column expressions for posts: calendar parts, scores, tiers, labels.

Every function returns a ``Column`` (or a dict of them) built from
``pyspark.sql.functions`` only, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Action weights of the viral coefficient (saves, shares, comments).
VC_WEIGHTS = (3.0, 2.0, 1.5)
# Viral score weights: likes + 2 * shares + 3 * saves.
VIRAL_SCORE_WEIGHTS = (1, 2, 3)
# Performance tiers by metric quartiles; viral-coefficient tiers by p50/p80/p95.
PERF_TIER_PROBS = (0.25, 0.5, 0.75)
PERF_TIER_LABELS = ("Low", "Medium", "High", "Viral")
VC_TIER_PROBS = (0.5, 0.8, 0.95)
VC_TIER_LABELS = ("Low", "Rising", "Viral", "Mega-Viral")
# Engagement bands for a scored rate: >= .08 VIRAL, >= .05 HIGH, >= .03 MEDIUM,
# >= .01 LOW, else VERY LOW.
ENGAGEMENT_BANDS = ((0.08, "VIRAL"), (0.05, "HIGH"), (0.03, "MEDIUM"), (0.01, "LOW"))
ENGAGEMENT_BAND_DEFAULT = "VERY LOW"
# Hour groups for the A/B battery: 6-9 morning_peak, 18-21 evening_peak.
HOUR_GROUPS = ((6, 9, "morning_peak"), (18, 21, "evening_peak"))
HOUR_GROUP_DEFAULT = "off_peak"
# Weekday names Monday first.
DAYS_OF_WEEK = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def col_or(columns: Iterable[str], name: str, default) -> Column:
    """A column if the frame has it, else a literal default."""
    return F.col(name) if name in set(columns) else F.lit(default)


# ------------------------------------------------------------------ B1 - B3
def parse_ts(x) -> Column:
    """B1: text → timestamp (wall time as written; a trailing ``Z`` / ``±hh:mm``
    offset is kept as the text's own clock, like ``fromisoformat``), bad → null.
    Parsing straight to ``timestamp_ntz`` is independent of the session zone."""
    wall = F.regexp_replace(F.trim(_c(x)), r"(Z|[+-]\d\d:?\d\d)$", "")
    return wall.try_cast("timestamp_ntz")


def iso_year(x) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(x))


def calendar_parts(ts: str = "post_datetime", *, year_mode: str = "iso") -> dict[str, Column]:
    """B2: hour, day name, day_num (Mon=0), month name, month_num, ISO week, year.

    ``year_mode="iso"`` pairs the ISO week with its ISO year (2024-12-30 is
    2025-W01); ``"calendar"`` reproduces the legacy calendar-year pairing.
    """
    t = F.col(ts)
    year = iso_year(t) if year_mode == "iso" else F.year(t)
    return {
        "hour": F.hour(t),
        "day": F.date_format(t, "EEEE"),
        "day_num": F.weekday(t),
        "month": F.date_format(t, "MMMM"),
        "month_num": F.month(t),
        "week": F.weekofyear(t),
        "year": year,
    }


def calendar_parts_nb(ts: str = "post_datetime") -> dict[str, Column]:
    """Notebook variant (hour, day of month, month)."""
    t = F.col(ts)
    return {"hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t)}


# ------------------------------------------------------------------ B4 - B8
def viral_score(columns: Iterable[str], likes="likes", shares="shares", saves="saves") -> Column:
    """Likes + 2*shares + 3*saves; a null action gives null (as pandas NaN)."""
    cols = set(columns)
    wl, ws, wv = VIRAL_SCORE_WEIGHTS
    return (col_or(cols, likes, 0) * wl + col_or(cols, shares, 0) * ws
            + col_or(cols, saves, 0) * wv)


def save_to_share(columns: Iterable[str], saves="saves", shares="shares") -> Column:
    """Saves / shares; shares 0 or null → saves; 0 when a column is missing."""
    cols = set(columns)
    if saves not in cols or shares not in cols:
        return F.lit(0.0)
    sv, sh = F.col(saves), F.col(shares)
    return F.coalesce(F.try_divide(sv, F.nullif(sh, F.lit(0))), sv.cast("double"))


def viral_coefficient(columns: Iterable[str], *, saves="saves", shares="shares",
                      comments="comments", reach="reach", weights=VC_WEIGHTS) -> Column:
    """(3·saves + 2·shares + 1.5·comments) / reach × 1000.

    Null actions count 0; null or zero reach counts 1; absent columns too.
    """
    cols = set(columns)
    sv = F.coalesce(col_or(cols, saves, 0), F.lit(0))
    sh = F.coalesce(col_or(cols, shares, 0), F.lit(0))
    cm = F.coalesce(col_or(cols, comments, 0), F.lit(0))
    rc = F.coalesce(F.nullif(col_or(cols, reach, 1), F.lit(0)), F.lit(1))
    w_sv, w_sh, w_cm = weights
    return (sv * w_sv + sh * w_sh + cm * w_cm) / rc * 1000


def high_value_ratio(columns: Iterable[str], *, saves="saves", shares="shares",
                     likes="likes", comments="comments") -> Column:
    """(saves+shares) / all four actions; a zero total divides by 1."""
    cols = set(columns)
    z = lambda n: F.coalesce(col_or(cols, n, 0), F.lit(0))
    hv = z(saves) + z(shares)
    tot = hv + z(likes) + z(comments)
    return hv / F.when(tot == 0, F.lit(1)).otherwise(tot)


def row_viral_coefficient(*, saves="saves", shares="shares", comments="comments",
                          reach="reach", weights=VC_WEIGHTS) -> Column:
    """Scoring variant — reach = max(reach or 1, 1), rounded to 4 places."""
    z = lambda n: F.coalesce(F.nullif(F.col(n), F.lit(0)), F.lit(0))
    rc = F.greatest(F.coalesce(F.nullif(F.col(reach), F.lit(0)), F.lit(1)), F.lit(1))
    w_sv, w_sh, w_cm = weights
    return F.round((z(saves) * w_sv + z(shares) * w_sh + z(comments) * w_cm) / rc * 1000, 4)


# ------------------------------------------------------------------ tiers
def tier_from_bounds(x, bounds: Sequence, labels: Sequence[str]) -> Column:
    """Label by ascending bounds with ``>=`` at each bound.

    ``bounds`` are Columns or numbers (len(labels) - 1 of them). A null value
    falls to the lowest label, as the reference's comparisons do for NaN.
    """
    v = _c(x)
    expr = F.lit(labels[0])
    chain = None
    for b, lab in sorted(zip(range(len(bounds)), labels[1:]), key=lambda t: -t[0]):
        cond = v >= (bounds[b] if isinstance(bounds[b], Column) else F.lit(bounds[b]))
        chain = F.when(cond, F.lit(lab)) if chain is None else chain.when(cond, F.lit(lab))
    return chain.otherwise(expr) if chain is not None else expr


def engagement_band(x) -> Column:
    """Fixed-threshold band of an engagement rate."""
    v = _c(x)
    chain = None
    for lo, lab in ENGAGEMENT_BANDS:
        chain = F.when(v >= lo, lab) if chain is None else chain.when(v >= lo, lab)
    return chain.otherwise(ENGAGEMENT_BAND_DEFAULT)


# ------------------------------------------------------------------ B13 - B15
def week_key(year="year", week="week") -> Column:
    """``YYYY-Www`` with a zero-padded week."""
    return F.concat(_c(year).cast("string"), F.lit("-W"), F.lpad(_c(week).cast("string"), 2, "0"))


def hour_group(hour="hour") -> Column:
    """morning_peak 6-9, evening_peak 18-21, else off_peak."""
    h = _c(hour)
    chain = None
    for lo, hi, lab in HOUR_GROUPS:
        cond = (h >= lo) & (h <= hi)
        chain = F.when(cond, lab) if chain is None else chain.when(cond, lab)
    return chain.otherwise(HOUR_GROUP_DEFAULT)


def clock_label(hour="hour", *, padded: bool = False) -> Column:
    """``h:00 AM/PM`` on a 12-hour clock; ``padded`` gives ``hh:00 AM/PM``."""
    h = _c(hour)
    ampm = F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM"))
    h12 = F.when(h <= 12, h).otherwise(h - 12)
    h12 = F.when(h12 == 0, F.lit(12)).otherwise(h12)
    hs = F.lpad(h12.cast("string"), 2, "0") if padded else h12.cast("string")
    return F.concat(hs, F.lit(":00 "), ampm)


# ------------------------------------------------------------------ M1 - M3
def estimate_reach(likes="likes", comments="comments", followers="follower_count") -> Column:
    """M1: likes*5 + comments*10, at least likes+comments, capped at followers if > 0."""
    lk, cm, fc = _c(likes), _c(comments), _c(followers)
    est = lk * 5 + cm * 10
    return F.when(fc > 0, F.least(F.greatest(est, lk + cm), fc)).otherwise(est)


def estimate_impressions(reach="reach") -> Column:
    """M2: int(reach * 1.3), truncation toward zero."""
    r = _c(reach) * 1.3
    return F.when(r >= 0, F.floor(r)).otherwise(F.ceil(r)).cast("bigint")


def trunc_int(x) -> Column:
    """Python ``int()`` of a double: truncation toward zero."""
    v = _c(x)
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("bigint")
