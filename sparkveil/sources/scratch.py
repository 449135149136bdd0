"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_COUNTER = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, readable by the driver and executors.

    It is ``spark.checkpoint.dir`` of the session. Only a local-mode session
    (tests) may leave it unset; then a temporary folder of this machine is used.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="sparkveil-")
    return _LOCAL_DIR[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage the way ``checkpoint()`` does, but keeps columns pruned
    and compressed. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkveil-{name}-{next(_COUNTER)}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)  # its buffers, unlike snappy's, do not wait for the garbage collector
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends; if it dies, the folder stays, so what is secret is sealed before it is written."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
