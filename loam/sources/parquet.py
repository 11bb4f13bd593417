"""Parquet files and folders: Spark's vectorised reader, and facts from their footers."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession

from . import files


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def metadata(spark: SparkSession, path: str):
    """pyarrow's view of one file's footer, of which only the end of the file is read."""
    import pyarrow.parquet as pq

    end = files.tail(spark, path, 8)
    if end[4:] != b"PAR1":
        raise ValueError(f"no Parquet file: {path}")
    return pq.read_metadata(io.BytesIO(b"PAR1" + files.tail(spark, path, int.from_bytes(end[:4], "little") + 8)))


def footer(spark: SparkSession, path: str) -> dict:
    """Bytes, rows, row groups, columns and codec of one file."""
    meta = metadata(spark, path)
    codec = meta.row_group(0).column(0).compression.lower() if meta.num_row_groups and meta.num_columns else None
    return {"bytes": files.size(spark, path), "rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": meta.num_columns, "codec": codec}


def has_field_ids(spark: SparkSession, path: str) -> bool:
    schema = metadata(spark, path).schema.to_arrow_schema()
    return any(b"PARQUET:field_id" in (f.metadata or {}) for f in schema)
