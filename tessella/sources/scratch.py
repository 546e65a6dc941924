"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` as a full URI.

    Where that is unset, as in tests, a session in one process takes a
    temporary folder; on a cluster no folder would be seen by all, so that is
    an error.
    """
    found = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tessella-")
        _OWN[spark.sparkContext.applicationId] = found
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tessella/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """``df`` as a table written to the shared folder, with the writer's options: cuts lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table that ``written`` made, once nothing is to read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
