"""Stopping searches and scans that run: what is started under a name is stopped by that name, from any thread."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs that this thread starts inside can be stopped by cancel(name); the call that waits for them then raises."""
    spark.sparkContext.addJobTag(name)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(name)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobsWithTag(name)
