"""Upsert by key, as a join and onto a partitioned table that survives a stop at any point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.session import delete, exists, mark


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]
) -> DataFrame:
    """Target rows with `update` taken from the source where the key matches, plus new keys.

    Keys absent from the source stay, as do the other columns of a matched row. NULL is a key
    value like any other.
    """
    t = target.withColumn("_old", F.lit(True)).alias("t")
    s = source.withColumn("_new", F.lit(True)).alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))

    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c in keys or c in update:
            return F.when(F.col("s._new"), new).otherwise(old)
        return F.when(F.col("t._old"), old).otherwise(new)

    return t.join(s, same, "full_outer").select(*[value(c).alias(c) for c in target.columns])


def read_if_present(
    spark: SparkSession, path: str, schema: str | None = None, base: str | None = None
) -> DataFrame | None:
    """The Parquet table at `path`, or None when there is none yet; other errors are raised.

    `path` may be a pattern over partition folders of the table at `base`.
    """
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Replace exactly the partitions present in `rows`.

    Rebalancing gives each partition few files and lets AQE split a large one over tasks.
    """
    (
        rows.hint("rebalance", *[F.col(c) for c in partition_by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def touched_partitions(table: DataFrame, touched: DataFrame, partition: str) -> DataFrame:
    """The rows of the touched partitions; which folders are read is known when the join runs.

    Rows without a partition value are always among them, so that none is overwritten unread.
    """
    found = table.join(touched.select(partition).distinct(), partition, "left_semi")
    return found.select(*table.columns).union(table.where(F.col(partition).isNull()))


def finish_replacement(spark: SparkSession, path: str, staging: str, partition: str) -> None:
    """Bring a staged replacement into the table, if one was left complete; run before reading.

    The staged copy holds whole partitions and a list of all that are touched, so doing it
    again changes nothing. Partitions that are listed and hold no row any more are removed.
    """
    if not exists(spark, f"{staging}/_complete"):
        return
    rows = spark.read.parquet(f"{staging}/rows")
    write_partitions(rows, path, partition)
    touched = spark.read.parquet(f"{staging}/touched")
    emptied = touched.join(rows.select(partition).distinct(), partition, "left_anti")
    for row in emptied.where(F.col(partition).isNotNull()).toLocalIterator():
        delete(spark, f"{path}/{partition}={row[0]}")
    # the mark goes first: without it the rest is a leftover that the next run replaces
    delete(spark, f"{staging}/_complete")
    delete(spark, staging)


def replace_partitions(
    rows: DataFrame, touched: DataFrame, path: str, staging: str, partition: str
) -> None:
    """Replace the partitions listed in `touched` by `rows`, which may be made from the table.

    Rows are staged in full first and marked complete; a run that stops later is finished by the
    next call of `finish_replacement`, one that stops before has changed nothing. `staging`
    belongs to this table alone.
    """
    spark = rows.sparkSession
    delete(spark, f"{staging}/_complete")
    touched.select(partition).distinct().write.mode("overwrite").parquet(f"{staging}/touched")
    rows.write.mode("overwrite").parquet(f"{staging}/rows")
    mark(spark, f"{staging}/_complete")
    finish_replacement(spark, path, staging, partition)


def upsert_partitions(
    spark: SparkSession,
    path: str,
    staging: str,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    partition: str,
) -> None:
    """Upsert the source into the partitioned table at `path`, reading only touched partitions.

    A replacement that an earlier run left unfinished is finished first, so no row of it is
    lost. Both folders are given by the caller and lie on shared storage.
    """
    finish_replacement(spark, path, staging, partition)
    target = read_if_present(spark, path)
    if target is None:
        merged = source
    else:
        old = touched_partitions(target, source, partition)
        merged = upsert(old, source.select(*target.columns), keys, update)
    if source.isEmpty():
        return
    replace_partitions(merged, source, path, staging, partition)
