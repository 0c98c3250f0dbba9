"""Folders for tables that the library keeps: in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local applications without a setting, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of the application if driver and
    executors are one process, and else, as nothing is known to be shared, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='bibloom-')}"
        folder = _own[context.applicationId]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in it that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
