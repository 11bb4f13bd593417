"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces of the operators' contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own serves in local mode; on a cluster that raises.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the files of what ``materialise`` returned; nothing may read it any more."""
    if (path := _path_of.pop(df, None) if df is not None else None) is not None:
        _written.remove((df.sparkSession, path))
        remove(df.sparkSession, path)


def written() -> int:
    """How many paths of the shared folder are in use, for ``discard_since``."""
    return len(_written)


def discard_since(mark: int, keep: DataFrame) -> None:
    """Deletes all paths since ``mark = written()`` but that of ``keep``."""
    for spark, path in _written[mark:]:
        if path != _path_of.get(keep):
            _written.remove((spark, path))
            remove(spark, path)


def fresh(columns: list[str], name: str) -> str:
    """A name like ``name`` that is no column's, in any case."""
    while name.lower() in {x.lower() for x in columns}:
        name += "_"
    return name


def trim_memory() -> None:
    """Gives what a Python worker has freed back to the system; called at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_spaces(text):
    """``text`` without U+0020 and U+0009 to U+000D; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text):
    """Number of runs of other characters than U+0020 and U+0009 to U+000D, as bigint; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
