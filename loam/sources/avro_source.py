"""Avro data files as DataFrames.

Files are read in ranges, each by a task of its own, which finds the blocks that start in its range by
the file's sync marker; only the columns that a query names are decoded, and none for counts. Stores
that Python can't open are read through Spark's ``binaryFile``, a task for each file.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import files
from .avro_codec import CODECS, AvroError, Reader, blocks, columns_reader, header

#: Rows of an Arrow batch; bytes of a range.
ROWS, RANGE = 4096, 32_000_000
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "fixed": T.BinaryType(), "enum": T.StringType(), "null": T.NullType()}


def spark_type(schema, names: dict | None = None) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of an Avro type. A union of null and one more type is that type, nullable."""
    names = {} if names is None else names
    if isinstance(schema, list):
        rest = [x for x in schema if x != "null"]
        if len(rest) != 1:
            raise AvroError(f"unsupported union: {schema}")
        return spark_type(rest[0], names)[0], len(rest) < len(schema)
    if isinstance(schema, str):
        schema = {"type": schema}
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (list, dict)):
        return spark_type(kind, names)
    if kind in names:
        return names[kind], False
    if kind == "record":
        made = T.StructType()
        for f in schema["fields"]:
            of, nullable = spark_type(f["type"], names)
            made.add(f["name"], of, nullable)
        names[schema["name"]] = made
        return made, False
    if kind == "array":
        return T.ArrayType(*spark_type(schema["items"], names)), False
    if kind == "map":
        return T.MapType(T.StringType(), *spark_type(schema["values"], names)), False
    if logical == "date":
        return T.DateType(), False
    if logical in ("timestamp-micros", "timestamp-millis", "local-timestamp-micros", "local-timestamp-millis"):
        return T.TimestampNTZType() if logical.startswith("local") else T.TimestampType(), False
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0)), False
    if kind not in _PLAIN:
        raise AvroError(f"unknown type: {kind}")
    if kind in ("enum", "fixed"):
        names[schema["name"]] = _PLAIN[kind]
    return _PLAIN[kind], False


def avro_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema in the header of the file, or of a folder's first file."""
    if files.is_folder(spark, path):
        found = [x for x in files.names(spark, path) if x.lower().endswith(".avro")]
        if not found:
            raise AvroError(f"no Avro files in {path}")
        path = f"{path.rstrip('/')}/{found[0]}"
    most = 1 << 16
    while True:
        try:
            schema = header(files.read(spark, path, most))[0]
            break
        except AvroError:
            if most >= files.size(spark, path):
                raise
            most *= 16
    made, _ = spark_type(schema)
    if not isinstance(made, T.StructType):
        raise AvroError("the records aren't of a record type")
    return made


def opened(path: str):
    """(file system, path in it) by which Python reaches a path; None if it can't."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), unquote(re.sub(r"^file:/*", "/", path))
    try:
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    except (pa.ArrowException, OSError, ValueError):
        return None


def read_avro(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All records of a file or folder; with ``columns``, these only (a column of nulls if there are none)."""
    schema = avro_schema(spark, path)
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns]) if columns else T.StructType([T.StructField("none", T.NullType())])
    names, arrow = schema.fieldNames() if columns is None or columns else [], to_arrow_schema(schema, timestamp_utc=True)

    def decoded(stream, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        read, out = None, [[] for _ in names]
        for avro, codec, count, data in blocks(stream, begin, end):
            if not names:
                yield pa.RecordBatch.from_arrays([pa.nulls(count, x.type) for x in arrow], schema=arrow)
                continue
            read = read or columns_reader(avro, names)
            r = Reader(CODECS[codec](data))
            for _ in range(count):
                read(r, out)
                if len(out[0]) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
                    out = [[] for _ in names]
        if names and out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, begin, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                store, inside = opened(where)
                with store.open_input_file(inside) as stream:
                    yield from decoded(stream, begin, end)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from decoded(io.BytesIO(content.as_py()), 0, 1 << 62)

    folder = files.is_folder(spark, path)
    if opened(path) is None:
        raw = spark.read.format("binaryFile")
        return (raw.option("pathGlobFilter", "*.avro") if folder else raw).load(path).select("content").mapInArrow(whole, schema)
    found = [f"{path.rstrip('/')}/{x}" for x in files.names(spark, path) if x.lower().endswith(".avro")] if folder else [path]
    parts = [(x, at, at + RANGE) for x in found for at in range(0, max(1, files.size(spark, x)), RANGE)]
    rows = spark.createDataFrame(parts, "path string, begin bigint, finish bigint").repartition(len(parts))
    return rows.mapInArrow(ranges, schema)
