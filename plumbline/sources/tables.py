"""Sources and sinks: parquet tables in, result tables and exports out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; columns and filters of the query reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_json(value: Any) -> str:
    return json.dumps(value, indent=2, default=str)
