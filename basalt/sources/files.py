"""Small files through Hadoop's FileSystem, so that tables live wherever Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist yet; False if it does. The text is written beside it and renamed, and the rename does
    not overwrite, so that a file is there whole or not at all, and one of several writers gets the name."""
    jvm, p, fs = _path(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), fs.getConf())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(beside, p, plain)
    except Exception:
        fs.delete(beside, False)
        if fs.exists(p):
            return False
        raise
    return True


def write_stream(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """Writes a new file piece by piece."""
    _, p, fs = _path(spark, path)
    stream = fs.create(p, False)
    try:
        for piece in pieces:
            stream.write(bytearray(piece))
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder to a name that is free."""
    jvm, p, fs = _path(spark, old)
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; empty if there is none."""
    _, p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    _, p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _path(spark, path)
    fs.delete(p, True)
