"""Iceberg and Avro: small writers for examples and tests, and the queries over what they write.

Sources of the driver's tables are Parquet only, so the queries first write a copy as an Iceberg
table or as Avro files, with a small encoder, to the shared folder.
"""

from __future__ import annotations

import atexit
import datetime
import json
import os
import struct
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .sources.avro_source import opened

_AVRO = {"bigint": "long", "int": "int", "double": "double", "float": "float", "string": "string", "boolean": "boolean"}


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or, in local mode where none is set, a temporary one. It is
    removed when the driver's Python ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{base.rstrip('/')}/loam-{uuid.uuid4().hex[:12]}" if base else tempfile.mkdtemp(prefix="loam-")
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _text(b: bytes) -> bytes:
    return _long(len(b)) + b


def encode(schema, value) -> bytes:
    """One value in Avro's binary form; of a union, the first branch that fits is taken."""
    if isinstance(schema, list):
        k = schema.index("null") if value is None else next(i for i, x in enumerate(schema) if x != "null")
        return _long(k) + encode(schema[k], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return encode(kind, value)
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("int", "long"):
        return _long(value)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    if kind in ("string", "bytes"):
        return _text(value.encode() if isinstance(value, str) else value)
    if kind == "array":
        return (_long(len(value)) + b"".join(encode(schema["items"], x) for x in value) if value else b"") + _long(0)
    if kind == "map":
        return (_long(len(value)) + b"".join(_text(k.encode()) + encode(schema["values"], v) for k, v in value.items()) if value else b"") + _long(0)
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    raise ValueError(f"unknown type {kind}")


def container(schema: dict, rows: list[dict], block: int = 1000, codec: str = "null") -> bytes:
    """An Avro object container of ``rows``."""
    import zlib

    sync = bytes(range(16))
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    out = [b"Obj\x01", _long(len(meta)), *[_text(k.encode()) + _text(v) for k, v in meta.items()], _long(0), sync]
    for i in range(0, len(rows), block):
        data = b"".join(encode(schema, r) for r in rows[i : i + block])
        if codec == "deflate":
            z = zlib.compressobj(wbits=-15)
            data = z.compress(data) + z.flush()
        out += [_long(len(rows[i : i + block])), _text(data), sync]
    return b"".join(out)


def record_schema(df: DataFrame, name: str = "row") -> dict:
    """An Avro record of nullable fields for a DataFrame of plain types."""
    return {"type": "record", "name": name, "fields": [{"name": c, "type": ["null", _AVRO[t]]} for c, t in df.dtypes]}


def write_avro(df: DataFrame, path: str, codec: str = "null", block: int = 1000) -> None:
    """A folder with one file for each partition, written by the executors; another run of a task writes the same file."""
    schema, names = record_schema(df), df.columns

    def run(batches):
        store, inside = opened(path)
        rows = [dict(zip(names, r, strict=True)) for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
        number = TaskContext.get().partitionId()
        store.create_dir(inside, recursive=True)
        attempt = f"{inside}/.{number}-{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out:
            out.write(container(schema, rows, block, codec))
        store.move(attempt, f"{inside}/part-{number:05}.avro")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()  # one number


def _bound(value) -> bytes | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return b"\1" if value else b"\0"
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, float):
        return struct.pack("<d", value)
    if isinstance(value, datetime.datetime):
        return struct.pack("<q", int((value - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1)))
    return str(value).encode()


_ICEBERG = {T.LongType: "long", T.IntegerType: "int", T.DoubleType: "double", T.FloatType: "float", T.StringType: "string", T.BooleanType: "boolean", T.TimestampNTZType: "timestamp", T.DateType: "date"}
_MANIFEST = {
    "type": "record", "name": "manifest_entry", "fields": [
        {"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]},
        {"name": "data_file", "type": {"type": "record", "name": "r2", "fields": [
            {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"},
            *[{"name": n, "type": {"type": "array", "items": {"type": "record", "name": f"k_{n}", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": t}]}}} for n, t in (("null_value_counts", "long"), ("nan_value_counts", "long"), ("lower_bounds", "bytes"), ("upper_bounds", "bytes"))],
        ]}},
    ],
}
_LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "content", "type": "int"}]}


def write_parquet(df: DataFrame, path: str, options: list[dict], types: dict | None = None) -> None:
    """A folder of Parquet files by another writer than Spark's, a partition each, with the k-th options of pyarrow's
    writer; ``types`` are the Arrow types of some columns."""

    def run(batches):
        number = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches))
        for name, kind in (types or {}).items():
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, table.column(at).cast(pa.binary()).cast(kind))
        store, inside = opened(path)
        store.create_dir(inside, recursive=True)
        attempt = f"{inside}/.{number}-{uuid.uuid4().hex}"
        pq.write_table(table, attempt, filesystem=store, **options[number % len(options)])
        store.move(attempt, f"{inside}/part-{number:05}.parquet")
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()  # one number


def write_iceberg(df: DataFrame, path: str, parts: int = 4, by: str | None = None, listed: str = "avro", transform: str | None = None) -> str:
    """A table of one snapshot: ``parts`` data files, ranged by a column, with bounds of all columns.

    ``listed``: "avro" lists manifests in Avro, "flat" lists entries there, one of them deleted, and "json" lists the data
    files in JSON, by paths of another machine. With ``transform`` (identity, truncate[W]) files have partition values of
    ``by``, taken from its least value, instead of bounds."""
    spark, fields = df.sparkSession, df.schema.fields
    ids = {f.name: i for i, f in enumerate(fields, 1)}
    ranged = df.repartitionByRange(parts, by) if by else df.repartition(parts)
    ranged.write.parquet(f"{path}/data")
    floats = [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    number = lambda n: F.when(~F.isnan(n), F.col(n)) if n in floats else F.col(n)  # noqa: E731  bounds leave NaN out
    facts = [F.count(F.lit(1)).alias("n"), *[g(number(f.name)).alias(f"{p}_{f.name}") for f in fields for p, g in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(f.name).isNull()).alias(f"nu_{f.name}") for f in fields], *[F.count_if(F.isnan(n)).alias(f"na_{n}") for n in floats]]
    rows = spark.read.schema(df.schema).parquet(f"{path}/data").groupBy(F.input_file_name().alias("file")).agg(*facts).collect()
    entries = []
    for r in rows:
        pairs = lambda p, r=r, names=None: [{"key": ids[n], "value": r[f"{p}_{n}"]} for n in (names or ids) if f"{p}_{n}" in r]
        bounds = lambda p, pairs=pairs: [{"key": x["key"], "value": b} for x in pairs(p) if (b := _bound(x["value"])) is not None]
        entries.append({"status": 1, "snapshot_id": 1, "data_file": {"content": 0, "file_path": f"data/{os.path.basename(r.file)}", "file_format": "PARQUET", "record_count": r.n, "null_value_counts": pairs("nu"), "nan_value_counts": pairs("na"), "lower_bounds": bounds("lo"), "upper_bounds": bounds("hi")}})
    record, location = _MANIFEST, path
    if transform:
        record = json.loads(json.dumps(_MANIFEST))
        record["fields"][2]["type"]["fields"].append({"name": "partition", "type": {"type": "record", "name": "r102", "fields": [{"name": "part", "type": ["null", "long"]}]}})
        for r, e in zip(rows, entries, strict=True):
            e["data_file"] |= {"lower_bounds": [], "upper_bounds": [], "partition": {"part": r[f"lo_{by}"]}}
    if listed == "json":
        location = "E:\\lake\\t"
        found = [{"manifest_path": f"file://e:\\lake\\{path.rstrip('/').rsplit('/', 1)[-1]}\\{e['data_file']['file_path']}", "added_rows_count": e["data_file"]["record_count"]} for e in entries]
        _write(spark, f"{path}/metadata/snap-1.avro", b"\r\n" + json.dumps(found, indent=1).encode())
    elif listed == "flat":
        gone = json.loads(json.dumps(entries[0] | {"data_file": None})) | {"status": 2, "data_file": entries[0]["data_file"] | {"file_path": "data/gone.parquet"}}
        _write(spark, f"{path}/metadata/snap-1.avro", container(record, [gone, *[e | {"status": k % 2} for k, e in enumerate(entries)]]))
    else:
        manifest = container(record, entries)
        _write(spark, f"{path}/metadata/m1.avro", manifest)
        _write(spark, f"{path}/metadata/snap-1.avro", container(_LIST, [{"manifest_path": "metadata/m1.avro", "manifest_length": len(manifest), "content": 0}]))
    schema = {"type": "struct", "schema-id": 0, "fields": [{"id": ids[f.name], "name": f.name, "required": False, "type": _ICEBERG[type(f.dataType)]} for f in fields]}
    meta = {"format-version": 2, "table-uuid": str(uuid.uuid4()), "location": location, "current-schema-id": 0, "schemas": [schema], "partition-specs": [{"spec-id": 0, "fields": [{"name": "part", "source-id": ids[by], "transform": transform, "field-id": 1000}] if transform else []}], "current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1, "manifest-list": "metadata/snap-1.avro", "summary": {"operation": "append"}}]}
    _write(spark, f"{path}/metadata/v1.metadata.json", json.dumps(meta).encode())
    return path


def _iceberg(table: str, by: str, text: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.connect(write_iceberg(spark.read.parquet(f"{sf_dir}/{table}.parquet"), f"{work_folder(spark)}/{table}", by=by, **options))
        return engine.sql(text)

    return run


def _one_value_a_file(text: str):
    """Orders with a column of one value in each file, which is the files' partition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_orderkey % 4 AS part_key", "o_totalprice")
        engine = Engine(spark)
        engine.connect(write_iceberg(orders, f"{work_folder(spark)}/parted", by="part_key", transform="identity"))
        return engine.sql(text)

    return run


def _parquet(columns: list[str], options: list[dict], text: str, types: dict | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_folder(spark)}/orders.parquet"
        write_parquet(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*columns).repartition(max(1, len(options)), "o_orderkey"), path, options, types)
        engine = Engine(spark)
        engine.connect(path)
        return engine.sql(text)

    return run


def _avro(table: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_folder(spark)}/{table}.avro"
        write_avro(spark.read.parquet(f"{sf_dir}/{table}.parquet"), path, codec="deflate")
        engine = Engine(spark)
        engine.connect(path)
        return engine.sql(text)

    return run


_SPECS = {
    "iceberg_scan": (_iceberg, ("supplier", "s_suppkey"), "SELECT *", "supplier"),
    "iceberg_aggregate": (_iceberg, ("orders", "o_orderkey"), "SELECT count(*) AS n, max(o_totalprice) AS most", "orders"),
    "iceberg_group_by": (_iceberg, ("lineitem", "l_orderkey"), "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity GROUP BY l_returnflag", "lineitem"),
    "iceberg_pruned": (_iceberg, ("orders", "o_totalprice"), "SELECT o_orderkey, o_totalprice WHERE o_totalprice < 5000 AND o_orderstatus IN ('F', 'O')", "orders"),
    "iceberg_order_limit": (_iceberg, ("orders", "o_orderkey"), "SELECT o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "orders"),
    "avro_scan": (_avro, ("nation",), "SELECT *", "nation"),
    "avro_filter": (_avro, ("supplier",), "SELECT s_suppkey, s_acctbal WHERE s_acctbal > 1000 AND s_nationkey <> 3", "supplier"),
    "avro_group_by": (_avro, ("supplier",), "SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS most GROUP BY s_nationkey", "supplier"),
}


def _with_from(text: str, table: str) -> str:
    from .plans.dialect import rewrite

    return rewrite(text, table, lambda name: name)


_DELTA = {"use_dictionary": False, "data_page_version": "2.0", "version": "2.6", "column_encoding": {"o_orderkey": "DELTA_BINARY_PACKED", "o_custkey": "DELTA_BINARY_PACKED", "o_orderstatus": "DELTA_BYTE_ARRAY", "o_orderpriority": "DELTA_LENGTH_BYTE_ARRAY", "o_totalprice": "PLAIN"}}
#: Queries over files whose layout Spark's writer doesn't give, with the SQL that says the same of the tables.
_LAYOUTS = {
    "iceberg_json_list": (_iceberg("supplier", "s_suppkey", "SELECT s_suppkey, s_name WHERE s_suppkey > 20", listed="json"), "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 20"),
    "iceberg_flat_list": (_iceberg("supplier", "s_suppkey", "SELECT s_nationkey, count(*) AS n GROUP BY s_nationkey", listed="flat"), "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey"),
    "iceberg_partitions": (_one_value_a_file("SELECT o_orderkey, o_totalprice WHERE part_key = 3"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 3"),
    "iceberg_join": (_iceberg("orders", "o_orderkey", "WITH few AS (SELECT o_orderkey, o_custkey, o_totalprice WHERE o_orderkey < 2000) SELECT a.o_custkey, count(*) AS n, max(b.o_totalprice) AS most FROM few a JOIN few b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey"), "WITH few AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 2000) SELECT a.o_custkey, count(*) AS n, max(b.o_totalprice) AS most FROM few a JOIN few b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey"),
    "iceberg_quotes": (_iceberg("customer", "c_custkey", "SELECT c_custkey WHERE c_mktsegment <> 'it''s' AND c_custkey < 500 AND c_mktsegment IS DISTINCT FROM 'BUILDING'"), "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'it''s' AND c_custkey < 500 AND c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "parquet_delta": (_parquet(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], [_DELTA], "SELECT *"), "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders"),
    "parquet_fixed": (_parquet(["o_orderkey", "CAST(substr(o_orderpriority, 1, 4) AS BINARY) AS start"], [{"use_dictionary": False}, {}], "SELECT o_orderkey, CAST(start AS STRING) AS start WHERE start <> CAST('2-HI' AS BINARY)", {"start": pa.binary(4)}), "SELECT o_orderkey, substr(o_orderpriority, 1, 4) AS start FROM orders WHERE substr(o_orderpriority, 1, 4) <> '2-HI'"),
    "parquet_nested": (_parquet(["o_orderkey", "IF(o_orderkey % 5 = 0, NULL, array(o_orderkey, NULL, o_custkey)) AS items", "struct(o_orderstatus AS s, map('p', o_totalprice) AS m) AS more"], [{"data_page_version": "2.0"}, {"data_page_version": "1.0"}], "SELECT o_orderkey, items[2] AS third, items[1] AS second, more.s AS status, more.m['p'] AS price WHERE more.s <> 'P'"), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS third, CAST(NULL AS BIGINT) AS second, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'"),
    "parquet_codecs": (_parquet(["o_orderkey", "o_orderpriority", "nullif(o_orderstatus, 'F') AS status"], [{"compression": c} for c in ("none", "snappy", "gzip", "zstd", "lz4")], "SELECT status, count(*) AS n, count(status) AS known, max(o_orderkey) AS high, min(o_orderpriority) AS low GROUP BY status"), "SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n, count(nullif(o_orderstatus, 'F')) AS known, max(o_orderkey) AS high, min(o_orderpriority) AS low FROM orders GROUP BY ALL"),
}

QUERIES = {k: v[0] for k, v in _LAYOUTS.items()} | {k: make(*args, text) for k, (make, args, text, _) in _SPECS.items()}
ORACLE_SQL = {k: v[1] for k, v in _LAYOUTS.items()} | {k: _with_from(text, table) for k, (_, _, text, table) in _SPECS.items()}
