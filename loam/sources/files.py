"""Small files and folders of any store that Spark reads, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    where, store = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where))


def size(spark: SparkSession, path: str) -> int:
    where, store = _at(spark, path)
    return store.getFileStatus(where).getLen()


def read(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's bytes, or the first ``most`` of them."""
    where, store = _at(spark, path)
    stream = store.open(where)
    try:
        n = store.getFileStatus(where).getLen()
        return bytes(stream.readNBytes(int(min(n, n if most is None else most))))
    finally:
        stream.close()


def tail(spark: SparkSession, path: str, most: int) -> bytes:
    """A file's last bytes, ``most`` at most."""
    where, store = _at(spark, path)
    n = store.getFileStatus(where).getLen()
    stream = store.open(where)
    try:
        stream.seek(max(0, n - most))
        return bytes(stream.readNBytes(int(min(n, most))))
    finally:
        stream.close()
