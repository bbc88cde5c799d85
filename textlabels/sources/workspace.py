"""Where intermediate tables are written.

That is a folder under ``spark.checkpoint.dir``, which every executor can
reach.  Where the session does not set it (as in tests), a folder beside the
tables of the session's warehouse takes its place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WRITTEN: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table; ``release`` removes it."""
    path = f"{shared_root(spark)}/textlabels/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage durably (it survives lost executors), and gives Catalyst
    the real size of the table for the joins that follow.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove every table this process has written; returns how many there were.

    To be called when no DataFrame that was built on them is needed any more.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in list(_WRITTEN):
        target = jvm.org.apache.hadoop.fs.Path(path)
        removed += target.getFileSystem(conf).delete(target, True)
        _WRITTEN.discard(path)
    return removed
