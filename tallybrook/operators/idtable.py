"""A table of the ids taken in so far, cut by a hash, of which a lookup reads only its share.

Each folder holds one bucket of the ids. A delivery reads and lists the folders its own ids fall
into, so small ones read few files however large the table is; one with more ids than there are
buckets reads all of it, two or three narrow columns. Parquet files carry Bloom filters of the
ids, by which a delivery of few ids skips most row groups of the files it opens.

A row may be in the table more than once: readers ask whether it is there. So rewriting a bucket into
one file needs no swap. One writer at a time.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.operators.upsert import read_if_present
from tallybrook.session import delete

ID = "transaction_id"
BUCKET = "id_bucket"
#: Folders of a table; a table is read with the number it was written with. Each run lists those it
#: reads: with 1024, listing took most of the time of deliveries of 10,000 payments.
BUCKETS = 64
#: Up to this many ids are compared in the scan itself, where the Bloom filters are.
PUSHED_IDS = 64
#: Files of a bucket from which on it is rewritten as few.
CROWDED = 16

BLOOM_FILTERS = {
    f"parquet.bloom.filter.enabled#{ID}": "true",
    # sizes follow the ids of a row group, not the 1 MB that fits any
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(ID), F.lit(BUCKETS)).cast("int").alias(BUCKET)


def share(ids: DataFrame, path: str, columns: str) -> DataFrame | None:
    """The buckets of the table at `path` that the ids fall into; None where there is no such.

    `columns` are those beside the id, as a schema. The driver learns the numbers of the buckets,
    and the ids themselves only if they are PUSHED_IDS or fewer.
    """
    numbers = [row[0] for row in ids.select(bucket_of()).distinct().collect()]
    found = _buckets(ids.sparkSession, path, columns, numbers)
    if found is None or len(numbers) >= PUSHED_IDS:
        return found
    few = ids.select(ID).distinct().limit(PUSHED_IDS + 1).collect()
    if len(few) > PUSHED_IDS:
        return found
    return found.where(reduce(or_, [F.col(ID) == row[0] for row in few], F.lit(False)))


def _buckets(
    spark: SparkSession, path: str, columns: str, numbers: list[int]
) -> DataFrame | None:
    if not numbers:
        return None
    chosen = ",".join(str(number) for number in sorted(numbers))
    schema = f"{ID} string, {columns}, {BUCKET} int"
    return read_if_present(spark, f"{path}/{BUCKET}={{{chosen}}}", schema, path)


def lookup(ids: DataFrame, path: str, columns: str) -> DataFrame | None:
    """The rows of the table whose id is among `ids`, each once."""
    found = share(ids, path, columns)
    if found is None:
        return None
    return found.join(ids.select(ID), ID, "left_semi").drop(BUCKET).distinct()


def add(rows: DataFrame, path: str, columns: str) -> None:
    """Append rows (the id and `columns`), then rewrite the buckets that have grown crowded.

    The driver lists the files of the table, which rewriting keeps to some per bucket.
    """
    spark = rows.sparkSession
    _append(rows.withColumn(BUCKET, bucket_of()), path)
    written = read_if_present(spark, path, f"{ID} string, {columns}, {BUCKET} int")
    if written is None:
        return
    files = written.inputFiles()
    per_bucket = Counter(_folder(file) for file in files)
    crowded = {folder for folder, n in per_bucket.items() if n >= CROWDED}
    if not crowded:
        return
    old = [file for file in files if _folder(file) in crowded]
    chosen = [int(folder.rpartition("=")[2]) for folder in crowded]
    _append(_buckets(spark, path, columns, chosen).distinct(), path)
    # a stop before this line leaves rows twice until the next rewrite
    for file in old:
        delete(spark, file)


def _folder(file: str) -> str:
    return file.rpartition("/")[0]


def _append(rows: DataFrame, path: str) -> None:
    writer = rows.hint("rebalance", F.col(BUCKET)).write.mode("append").options(**BLOOM_FILTERS)
    writer.partitionBy(BUCKET).parquet(path)
