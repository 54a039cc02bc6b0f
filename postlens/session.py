"""Session helpers.

Cluster jobs read ``spark.checkpoint.dir`` from the session (the shared folder
the cluster names).  Only where it is unset and everything runs in one local JVM
(tests) do we point it at a fresh scratch folder; a cluster without a shared
folder is refused, since its executors could not read each other's files.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Fixed session settings used by tests and bench.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "postlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # pragma: no cover - Spark Connect has no SparkContext
            d = None
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {master or 'a cluster'} it must name a shared folder")
        d = tempfile.mkdtemp(prefix="postlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # pragma: no cover - Spark Connect has no SparkContext
        pass
    return d


_STAGES: list[str] = []


def stage_path(spark: SparkSession, tag: str = "stage") -> str:
    """A new path in the shared folder for an intermediate result, noted for ``clear_stages``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    return path


def stage_mark() -> int:
    """The number of intermediate results noted so far."""
    return len(_STAGES)


def clear_stages(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Delete the intermediate results noted after the mark ``since`` (all of them by
    default), but the last few; call it when no frame that is still needed is built on
    them.  Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _STAGES[since:len(_STAGES) - but_last]
    del _STAGES[since:len(_STAGES) - but_last]
    done = 0
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        done += bool(p.getFileSystem(conf).delete(p, True))
    return done


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
