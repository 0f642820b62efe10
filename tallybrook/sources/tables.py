"""Table and stream readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    split_column: str,
    bounds: tuple[str, str],
    parts: int = 32,
) -> DataFrame:
    """A warehouse table in `parts` concurrent range reads of `split_column`."""
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("dbtable", table)
        .option("partitionColumn", split_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", parts)
        .load()
    )


def message_stream(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """An unbounded table with the raw messages in `value`, from any source that has one."""
    return spark.readStream.format(fmt).options(**options).load().select("value")


#: Settings of a topic unless others are given: a new checkpoint starts with the oldest message
#: and skips none, and the stream goes on where the broker has lost some.
KAFKA_SETTINGS = {"startingOffsets": "earliest", "failOnDataLoss": "false"}


def job_messages(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """The message stream of a job; a topic is read with KAFKA_SETTINGS unless told otherwise."""
    return message_stream(spark, fmt, job_options(fmt, options))


def job_options(fmt: str, options: Mapping[str, str]) -> dict[str, str]:
    return {**(KAFKA_SETTINGS if fmt == "kafka" else {}), **options}


def table_stream(spark: SparkSession, path: str, schema: str | StructType, **options: str) -> DataFrame:
    """A Parquet table read as a stream of its files, new ones included."""
    return spark.readStream.schema(schema).options(**options).parquet(path)
