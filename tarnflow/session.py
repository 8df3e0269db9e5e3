"""Spark sessions and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WORK: list[str] = []


def get_spark(app: str = "tarnflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC, AQE). Cluster
    sizing stays with the caller; ``conf`` keys have _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; our own only where it is
    unset and the master is local, as in tests. On a cluster a folder of this
    machine would be no use to executors: an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnflow-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, freed by ``release_work`` or at exit."""
    path = f"{shared_dir(spark)}/work/{label}-{uuid.uuid4().hex}"
    _WORK.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a work path, and a scan of it."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_work(spark: SparkSession) -> None:
    """Delete all work paths. Results that read them must have been written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WORK:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WORK.pop())
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _WORK else None
    if spark is not None:
        try:
            release_work(spark)
        except Exception:  # the JVM may be gone already
            _WORK.clear()
