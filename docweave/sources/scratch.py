"""Folders for what a session writes besides its results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, of this machine in local mode, as in tests, and an error on a cluster."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", given)
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"
