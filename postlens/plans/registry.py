"""Query registry shared by ``__spark_entry__``, bench and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_INTS = (T.ByteType, T.ShortType, T.IntegerType)


def round_half_away(c, digits: int = 6):
    """round(x · 10^d) / 10^d with half away from zero on the binary product —
    the same arithmetic as the oracle engine, so ties land on the same side."""
    m = float(10 ** digits)
    y = c * m
    return F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)) / m


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles to ``digits`` places and widen small ints to bigint, so the
    result compares with the oracle independent of the engine's last bits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_half_away(c.cast("double"), digits)
        elif isinstance(f.dataType, _INTS):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
