"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for. All of them let Spark choose from measured sizes.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE may hash-join a shuffled side whose every partition was measured below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Call-site capture for error messages costs several driver round trips per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "gleanset", **conf: str) -> SparkSession:
    """A session with :data:`ENGINE_CONF`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**ENGINE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """Scratch of a local session without a shared folder, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="gleanset-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a machine-local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _local_folder().name
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write a table and read it back, so that what follows never recomputes (or re-infers) it."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
