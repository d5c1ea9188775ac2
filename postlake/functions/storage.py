"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place under the folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder of this machine serves; on a cluster its lack is
    an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="shared-"))
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
