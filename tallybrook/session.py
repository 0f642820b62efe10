"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job relies on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Event times on the wire carry no zone and mean UTC, so text must be read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def cloned(spark: SparkSession, **conf: str) -> SparkSession:
    """A session with the same tables and settings and some of its own, for one query.

    `conf` keys use `__` for dots; the given session keeps its settings.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        own.conf.set(key.replace("__", "."), value)
    return own


_local_root: str | None = None
_own_folders: set[str] = set()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables and checkpoints that all executors can reach.

    It lies in the folder the cluster names in spark.checkpoint.dir, below the application's id.
    Only a local session without that setting gets a folder of its own machine. What an
    application leaves there goes when its driver ends.
    """
    global _local_root
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="tallybrook-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        root = _local_root
    own = f"{root.rstrip('/')}/tallybrook/{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        files, place = _file_system(spark, own)
        atexit.register(_remove, files, place)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def _remove(files, place) -> None:
    """Remove the application's folder; without a JVM any more, it is left to the store."""
    try:
        files.delete(place, True)
    except (Py4JError, OSError):
        log.warning("%s is left in the shared folder", place)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of a table, if it is there."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    files, place = _file_system(spark, path)
    files.create(place, True).close()
