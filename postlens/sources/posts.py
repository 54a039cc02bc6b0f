"""Posts: the wide fact table every engagement operator reads.

``posts_from_tables`` maps the driver's TPC-H-like tables onto the posts schema
(see FIXTURES.md §3); ``scan_posts`` reads real exports (CSV or Parquet) with an
explicit schema; ``ingest_posts`` adds the calendar and score columns and drops
rows without the metric (the load step of the dashboard).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import columns as C

POSTS_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("post_datetime", T.TimestampNTZType()),
    T.StructField("post_date", T.DateType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("content_category", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("has_call_to_action", T.IntegerType()),
    T.StructField("follower_count", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("shares", T.LongType()),
    T.StructField("saves", T.LongType()),
    T.StructField("reach", T.LongType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("followers_gained", T.LongType()),
    T.StructField("caption_length", T.IntegerType()),
    T.StructField("hashtags_count", T.IntegerType()),
    T.StructField("engagement_rate", T.DoubleType()),
    T.StructField("performance_bucket_label", T.StringType()),
])


def posts_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts adapter over lineitem ⋈ part.

    The join is left to Catalyst: ``part`` is broadcast only when its
    statistics fall under ``spark.sql.autoBroadcastJoinThreshold`` (the size
    check), otherwise it is a sort-merge join on the part key.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey, "inner")
    pk, sk, ok = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return j.select(
        F.concat_ws("-", ok.cast("string"), F.col("l_linenumber").cast("string"),
                    pk.cast("string"), sk.cast("string"),
                    F.to_date("l_shipdate").cast("string")).alias("post_id"),
        sk.alias("account_id"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=(pk % 24).cast("int"))).alias("post_datetime"),
        F.to_date("l_shipdate").alias("post_date"),      # the times of a date lie within it
        F.col("p_type").alias("content_category"),
        F.when(F.col("l_returnflag") == "R", "reel")
         .when(F.col("l_returnflag") == "A", "image").otherwise("carousel").alias("media_type"),
        F.when(F.col("l_linestatus") == "O", "creator").otherwise("brand").alias("account_type"),
        F.when(pk % 3 == 0, "Hashtags").when(pk % 3 == 1, "Home")
         .otherwise("Explore").alias("traffic_source"),
        (F.col("l_linenumber") % 2).cast("int").alias("has_call_to_action"),
        F.floor(price).cast("bigint").alias("follower_count"),
        F.floor(price / 50).cast("bigint").alias("likes"),
        F.when(pk % 41 == 0, F.lit(None)).otherwise(sk % 50).alias("comments"),
        (pk % 40).alias("shares"),
        (ok % 60).alias("saves"),
        F.when(pk % 97 == 0, F.lit(0)).when(pk % 89 == 0, F.lit(None))
         .otherwise(F.floor(price / 10).cast("bigint") + 500).alias("reach"),
        (F.floor(price / 8).cast("bigint") + 500).alias("impressions"),
        (F.floor(qty).cast("int") % 31).alias("hashtags_count"),
        (F.floor(qty).cast("int") * 7).alias("caption_length"),
        (sk % 20).alias("followers_gained"),
        F.when(pk % 101 == 0, F.lit(None))
         .otherwise(F.col("l_discount") + F.col("l_tax") + qty / 1000).alias("engagement_rate"),
    )


# Fixed value: the posts adapter as one SQL text (FIXTURES.md §3); it runs
# unchanged in Spark SQL and DuckDB and is what the oracle queries start from.
POSTS_ADAPTER_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                 CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                 CAST(CAST(l_shipdate AS DATE) AS STRING))          AS post_id,
       l_suppkey                                                    AS account_id,
       l_shipdate + INTERVAL '1' HOUR * (l_partkey % 24)            AS post_datetime,
       p_type                                                       AS content_category,
       CASE l_returnflag WHEN 'R' THEN 'reel' WHEN 'A' THEN 'image'
            ELSE 'carousel' END                                     AS media_type,
       CASE l_linestatus WHEN 'O' THEN 'creator' ELSE 'brand' END   AS account_type,
       CASE WHEN l_partkey % 3 = 0 THEN 'Hashtags' WHEN l_partkey % 3 = 1
            THEN 'Home' ELSE 'Explore' END                          AS traffic_source,
       CAST(l_linenumber % 2 AS INT)                                AS has_call_to_action,
       CAST(floor(l_extendedprice) AS BIGINT)                       AS follower_count,
       CAST(floor(l_extendedprice / 50) AS BIGINT)                  AS likes,
       CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_suppkey % 50 END  AS comments,
       l_partkey % 40                                               AS shares,
       l_orderkey % 60                                              AS saves,
       CASE WHEN l_partkey % 97 = 0 THEN 0
            WHEN l_partkey % 89 = 0 THEN NULL
            ELSE CAST(floor(l_extendedprice / 10) AS BIGINT) + 500 END AS reach,
       CAST(floor(l_extendedprice / 8) AS BIGINT) + 500             AS impressions,
       CAST(floor(l_quantity) AS INT) % 31                          AS hashtags_count,
       CAST(floor(l_quantity) AS INT) * 7                           AS caption_length,
       l_suppkey % 20                                               AS followers_gained,
       CASE WHEN l_partkey % 101 = 0 THEN NULL
            ELSE l_discount + l_tax + l_quantity / 1000 END         AS engagement_rate
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def scan_posts(spark: SparkSession, path: str, *, fmt: str = "csv",
               schema: T.StructType | None = None) -> DataFrame:
    """A1: read every file of a posts export (not just the first one).

    Header names are trimmed and lower-cased; CSV is read with an explicit
    schema (no inference pass over 100 TB).  An empty folder raises, and so does
    a file whose header differs from the others' (its columns would be mixed up).
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        if not header:
            raise FileNotFoundError(f"no rows under {path}")
        cleaned = [c.strip().lower() for c in header]
        by_name = {f.name: f for f in (schema or POSTS_SCHEMA).fields}
        fields = [T.StructField(h, by_name[c].dataType if c in by_name else T.StringType())
                  for h, c in zip(header, cleaned)]
        df = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
              .schema(T.StructType(fields)).csv(path).toDF(*cleaned))
    else:
        df = spark.read.format(fmt).load(path)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """B4n: pandas treats NaN as missing; Spark does not.  NaN → null."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floats})


def ingest_posts(df: DataFrame, *, ts: str = "post_datetime", metric: str = "engagement_rate",
                 year_mode: str = "iso") -> DataFrame:
    """Load step: B1 parse, B2 calendar parts, B4 viral score, B5 save:share, C4."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        df = df.withColumn(ts, C.parse_ts(ts))
    df = df.withColumns(C.calendar_parts(ts, year_mode=year_mode))
    df = df.withColumns({
        "viral_score": C.viral_score(df.columns),
        "save_to_share": C.save_to_share(df.columns),
    })
    return df.where(F.col(metric).isNotNull())
