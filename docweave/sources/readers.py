"""Documents from files, and tables from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, title, body): a row for each file; the title is its first heading, else its name."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    heading = F.nullif(F.regexp_extract("value", r"(?m)^#+[ \t]+(.+?)[ \t]*$", 1), F.lit(""))
    return files.select(where.alias("path"), F.coalesce(heading, F.element_at(F.split(where, "/"), -1)).alias("title"), F.col("value").alias("body"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
