"""Append-only stores (A4-A7, A9): training log, augmented pool, prediction
sink, model store.  Paths are folders on the shared file system; writes are
Spark jobs (append / overwrite), so a lost executor only reruns its tasks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.combine import new_only
from postlens.session import path_exists

LOG_SCHEMA = T.StructType([
    T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    T.StructField("n_augmented", T.LongType()), T.StructField("n_trees", T.LongType()),
    T.StructField("timestamp", T.StringType())])


def training_log_append(metrics: DataFrame, path: str) -> None:
    """A4: append one metrics record (JSON lines)."""
    metrics.select(*[F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA.fields]) \
        .coalesce(1).write.mode("append").json(path)


def training_log_read(spark: SparkSession, path: str, *, legacy_array: bool = False) -> DataFrame:
    """A4: all runs oldest first; unreadable or missing → empty.  ``legacy_array``
    reads the single pretty-printed JSON array file of the reference."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    df = (spark.read.schema(LOG_SCHEMA).option("multiLine", legacy_array)
          .option("mode", "PERMISSIVE").json(path))
    return df.where(F.col("timestamp").isNotNull()).orderBy("timestamp")


def pool_append(new: DataFrame, pool_path: str, *, key: str = "link", dedup_batch: bool = False
                ) -> DataFrame:
    """A5: append the rows whose key is not in the pool yet (F1 anti-join);
    duplicates inside the batch are kept unless ``dedup_batch``.  Returns a
    one-row frame (added, total) computed after the write."""
    spark = new.sparkSession
    fresh = new
    if path_exists(spark, pool_path):          # any other failure to read the pool is an error
        existing = spark.read.parquet(pool_path)
        if key in new.columns and key in existing.columns:
            fresh = new_only(new, existing, key=key)
    if dedup_batch and key in fresh.columns:
        fresh = fresh.dropDuplicates([key])
    stage = fresh.withColumn("__added_at", F.current_timestamp()).cache()
    added = stage.count()
    stage.drop("__added_at").write.mode("append").option("mergeSchema", "true").parquet(pool_path)
    stage.unpersist()
    total = spark.read.option("mergeSchema", "true").parquet(pool_path).count()
    return spark.createDataFrame([(added, total)], "added long, total long")


def pool_preview(pool: DataFrame, *, n: int = 50, order: str = "scraped_at", key: str = "link",
                 columns: list[str] | None = None) -> DataFrame:
    """Last ``n`` rows by ``order`` (file order does not exist in Spark)."""
    keep = [c for c in (columns or pool.columns) if c in pool.columns]
    return pool.orderBy(F.col(order).desc(), F.col(key)).limit(n).select(*keep)


def predictions_sink(scored: DataFrame, path: str, *, fmt: str = "csv") -> None:
    """Write scored rows (overwrite)."""
    w = scored.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def model_store_save(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    """Fitted pipeline plus its metrics row."""
    model.write().overwrite().save(f"{path}/pipeline")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def model_store_load(spark: SparkSession, path: str):
    """(model, metrics), or None when it is not there or was not written to the end
    (the caller trains)."""
    if not (path_exists(spark, f"{path}/pipeline/metadata/_SUCCESS") and path_exists(spark, f"{path}/metrics/_SUCCESS")):
        return None
    return PipelineModel.load(f"{path}/pipeline"), spark.read.json(f"{path}/metrics")


def input_fingerprint(*frames: DataFrame) -> str:
    """Stable key of the files behind some DataFrames (name, size, mtime)."""
    import hashlib
    parts = []
    for f in frames:
        spark = f.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in sorted(f.inputFiles()):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            st = p.getFileSystem(conf).getFileStatus(p)
            parts.append(f"{path}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def load_or_fit(spark: SparkSession, key: str, fit, *, root: str | None = None):
    """A7 lifecycle: load the pipeline (and metrics) stored under ``key`` if
    present and readable, else call ``fit() -> (model, metrics)``, save, return.
    Models live under the shared checkpoint folder unless ``root`` is given."""
    import os
    from postlens.session import checkpoint_dir
    path = os.path.join(root or checkpoint_dir(spark), "models", key)
    got = model_store_load(spark, path)
    if got is not None:
        return got
    model, metrics = fit()
    model_store_save(model, metrics, path)
    return model, metrics
