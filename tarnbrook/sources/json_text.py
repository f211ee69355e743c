"""Records from and to JSON text, one a line; invalid lines come back with their error instead of being lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import parse_records, record_json_column


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, hash, data_json, error) of each line of the text files at `path`."""
    return parse_records(spark.read.text(path)).select("record.*")


def write_records(state: DataFrame, path: str) -> None:
    state.select(record_json_column(F.col("id"), F.col("hash"), F.col("data_json")).alias("value")).write.text(path)
