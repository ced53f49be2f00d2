"""Where a job may put intermediate files: the cluster's shared folder, never a node's disk."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@cache
def _session_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared checkpoint folder named by the session.

    Only a local session without that setting (tests, a laptop) falls back to a temporary
    folder, one for the whole session and removed with it; on a cluster it is an error.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that all nodes share")
        root = _session_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table below the shared folder: computed once, read often.

    Survives lost executors, and each reader prunes columns of its own.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
