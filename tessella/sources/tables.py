"""Readers. Parquet is the default; the others take an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of ``numbered_table`` that give the order of its rows.
PLACE = ["_file", "_row"]


def numbered_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with the place of each row: its file and its number there."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of transactions: customer_id, ts, amount."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS customer_id", "o_orderdate AS ts", "o_totalprice AS amount")


def delimited(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    return spark.read.options(header="true", **options).csv(path, schema=schema)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 16) -> DataFrame:
    """Files that arrive under ``path``, as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
