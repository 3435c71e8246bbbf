"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_MADE: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str = "eventlens") -> str:
    """A folder of one's own under ``spark.checkpoint.dir``.

    Only a local session may name none, as in tests; on a cluster a folder of
    the driver's would be no use to executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _MADE:
            _MADE[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _MADE[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that outlives any executor; later steps read only the
    columns they need."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of one's own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
