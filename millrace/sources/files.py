"""File sources and sinks: JSON arrays, CSV traces, counter files, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files with a JSON object a line, as write_json_rows makes them; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that hold a JSON array each; a malformed file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls are written, so that a row of nulls stays a row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_trace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_reports(spark: SparkSession, pattern: str, schema: T.StructType, name: str) -> DataFrame:
    """Report files with the parts that the regular expression `name` captures from their names: case, lane, repetition."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_file", F.input_file_name())
    return df.select("*", *[F.regexp_extract("_file", name, k + 1).alias(c) for k, c in enumerate(("case", "lane", "repetition"))]).drop("_file")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """event, n of files whose lines are n,unit,event,...; lines without a number are left out."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(F.get(parts, F.lit(0)).rlike("^[0-9]+$")).select(F.get(parts, F.lit(2)).alias("event"), F.get(parts, F.lit(0)).cast("long").alias("n"))
