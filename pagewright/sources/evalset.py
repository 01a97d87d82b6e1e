"""Labelled questions, one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query string, expected_url string, expected_snippet string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cases with the declared columns; blank lines are none, a line that isn't JSON is an error."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path).where("query IS NOT NULL").na.fill("", ["expected_snippet"])
