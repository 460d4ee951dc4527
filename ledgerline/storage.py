"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, as a URI with its scheme.

    Only where that is unset and the master is local, as in tests, a temporary folder of this session is
    taken; executors on other machines wouldn't share it, so on a cluster an unset folder is an error.
    """
    named = spark.conf.get(DIR_SETTING, None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{DIR_SETTING} has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set(DIR_SETTING, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later uses survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path made by scratch_path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
