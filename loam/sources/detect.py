"""What kind of table a path holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import files

PARQUET, AVRO, ICEBERG = "parquet", "avro", "iceberg"


class UnknownSource(ValueError):
    """The path exists but is no table that can be read, or doesn't exist."""


def detect(spark: SparkSession, path: str) -> str:
    """By extension, then by a ``metadata`` folder, then by the first four bytes."""
    lower = path.rstrip("/").lower()
    for kind in (PARQUET, AVRO):
        if lower.endswith(f".{kind}"):
            return kind
    if not files.exists(spark, path):
        raise UnknownSource(f"no such path: {path}")
    if files.is_folder(spark, path):
        inside = files.names(spark, path)
        if "metadata" in inside:
            return ICEBERG
        for kind in (PARQUET, AVRO):
            if any(x.lower().endswith(f".{kind}") for x in inside):
                return kind
        raise UnknownSource(f"a folder without metadata or data files: {path}")
    magic = files.read(spark, path, 4)
    if magic == b"PAR1":
        return PARQUET
    if magic == b"Obj\x01":
        return AVRO
    raise UnknownSource(f"neither Parquet nor Avro: {path}")
