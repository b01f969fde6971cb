"""Files beside Spark's own readers and writers: file systems by URI, and the folder that a session's tasks share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def file_system(uri: str) -> tuple:
    """(file system, path) of a folder or file as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(known(uri))


def known(uri: str) -> str:
    """The URI as pyarrow names it, to which s3a and s3n are S3."""
    return re.sub(r"^s3[an]://", "s3://", uri)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that names none (tests) gets
    one of our own; on a cluster, whose executors would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named and context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    if not named:
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="skipweave-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            context.setCheckpointDir(f"file://{own}")
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under shared_dir()."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
