"""Small helpers over the Hadoop file system of the session, so that any shared storage works."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; a local one only where none is named and there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and (spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local")):
        raise RuntimeError("intermediate tables need a folder all executors share: set spark.checkpoint.dir")
    root = root or _local_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shoptide-", dir="/tmp")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop = _path(spark, path)
    fs.mkdirs(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _path(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop))


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, hadoop = _path(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(hadoop, target):
        raise OSError(f"could not rename {old} to {new}")


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _path(spark, path)
    fs.delete(hadoop, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file so that readers see all of it or nothing."""
    fs, hadoop = _path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if not fs.rename(part, hadoop):
        raise OSError(f"could not put {path}")


def get_text(spark: SparkSession, path: str) -> str:
    fs, hadoop = _path(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
