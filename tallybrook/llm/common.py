"""What several operators share: intermediate tables, word rules, running totals."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

import tallybrook
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.session import work_dir

#: The white space that separates words, as a pattern.
SPACE = r"[\x20\x09-\x0D]+"

HASH_BITS = 60

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(tallybrook.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tallybrook-")) / "tallybrook-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """`mapInArrow` for functions of this package."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared work folder and read again, so that nothing before them
    is computed twice and a lost executor costs only its running tasks.

    Spark removes the shuffle files and broadcasts of a finished step once the driver has collected
    its plan. A chain of steps would pile up both until the driver's heap is full, so each
    step ends with a collection.
    """
    path = work_dir(rows.sparkSession, f"llm-{purpose}")
    rows.write.parquet(path)
    rows.sparkSession.sparkContext._jvm.System.gc()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def renamed(docs: DataFrame) -> tuple[list[Column], str]:
    """All columns of docs under names that clash with nothing, and the new name of `text`."""
    names = docs.columns
    columns = [F.col(f"`{name}`").alias(f"_c{i}") for i, name in enumerate(names)]
    return columns, f"_c{names.index('text')}"


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names again."""
    return rows.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(docs.columns)])


#: Rows that a Python worker converts at a time: batches hold many more, and texts may be long.
SLICE_ROWS = 512


def slices(batches):
    """The batches in slices that share their memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def words(text: Column) -> Column:
    """Runs of characters other than white space, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def md5_key(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a number that is not negative."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bucket_bits(rows: int, per_bucket: int = 20_000) -> int:
    """Bits of a hash that cut `rows` rows into buckets of about `per_bucket`."""
    return max(0, min(24, (max(rows, 1) // per_bucket).bit_length()))


def running_sum(
    rows: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], value: str, bits: int
) -> DataFrame:
    """Add `before`, the sum of `value` over the earlier rows of a row's group.

    Order is by `key`, a 60-bit hash, then `ties`. Sums per hash bucket are totalled in one small
    window per group and the rest within buckets, so a hot group is spread over many tasks.
    """
    bucketed = rows.withColumn("_bucket", F.shiftright(F.col(key), HASH_BITS - bits))
    per_bucket = bucketed.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = per_bucket.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("_bucket").alias("_start_bucket"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(key, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("_bucket") == F.col("_start_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return (
        bucketed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, same)
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .select(*rows.columns, "before")
    )
