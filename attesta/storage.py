"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
and Spark runs in one process (tests, notebooks) a local one is made.  A table
cuts lineage like a checkpoint, is computed once and is stored compressed, and
a lost executor costs no more than the tasks it was running.  What is not
dropped before goes when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MARKED: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="attesta-shared-"))
        base = _OWN[0]
    files, where = _file_system(spark, base)
    whole = str(files.makeQualified(where).toString())
    return whole.replace("file:/", "file:///", 1).rstrip("/") if whole.startswith("file:/") and not whole.startswith("file://") else whole.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def arrow_files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system of a URI whose path stands as it is, and the path there."""
    scheme, rest = uri.split("://", 1)
    authority, _, path = rest.partition("/")
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}://{authority}/{quote(path)}")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's own folder, which is deleted when the driver ends."""
    own = f"{folder(spark)}/attesta/{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        _MARKED.add(own)
        files, where = _file_system(spark, own)
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh table and return the table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._attesta_path = path
    return saved


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``save`` that nothing lazy reads any more."""
    for t in tables:
        delete(t.sparkSession, t._attesta_path)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
