"""Iceberg v1 and v2 tables: metadata, manifests and file lists on the driver, data by Spark's Parquet reader."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import files
from .avro_codec import records
from .parquet import has_field_ids
from .pruning import FileStats, decode_bound, skip

_PRIMITIVES = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType(),
}
#: Status of a manifest entry: 0 existing, 1 added, 2 deleted.
DELETED = 2
#: Up to so many manifests are read by the driver.
FEW_MANIFESTS = 8


class IcebergError(ValueError):
    """The table is damaged or uses what isn't supported."""


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: object
    required: bool


@dataclass(frozen=True)
class DataFile:
    path: str
    format: str
    stats: FileStats = field(compare=False)


@dataclass
class Metadata:
    """What a table's metadata file says."""

    version: int
    uuid: str | None
    location: str | None
    schemas: dict[int, list[Column]]
    current_schema: int
    specs: list[dict]
    snapshots: list[dict]
    current_snapshot: int | None
    properties: dict

    @classmethod
    def parse(cls, text: str | bytes) -> Metadata:
        raw = json.loads(text)
        listed = raw.get("schemas") or [raw["schema"]]
        schemas = {s.get("schema-id", 0): [Column(f["id"], f["name"], f["type"], f.get("required", False)) for f in s["fields"]] for s in listed}
        now = raw.get("current-snapshot-id")
        specs = raw.get("partition-specs")
        if specs is None:
            single = raw.get("partition-spec") or []
            specs = [{"spec-id": 0, "fields": single}] if isinstance(single, list) else [single]
        return cls(raw["format-version"], raw.get("table-uuid"), raw.get("location"), schemas, raw.get("current-schema-id", next(iter(schemas))), specs, raw.get("snapshots") or [], None if now in (None, -1) else now, raw.get("properties") or {})

    @property
    def schema(self) -> list[Column]:
        if self.current_schema not in self.schemas:
            raise IcebergError(f"no schema {self.current_schema}")
        return self.schemas[self.current_schema]

    def snapshot(self, snapshot_id: int | None = None) -> dict | None:
        wanted = self.current_snapshot if snapshot_id is None else snapshot_id
        found = next((s for s in self.snapshots if s["snapshot-id"] == wanted), None)
        if found is None and wanted is not None:
            raise IcebergError(f"no snapshot {wanted}")
        return found

    @property
    def struct(self) -> T.StructType:
        return self.struct_of(False)

    def struct_of(self, ids: bool) -> T.StructType:
        """The current schema; with ``ids``, Spark's Parquet reader finds columns by field id."""
        return T.StructType([T.StructField(c.name, spark_type(c.type), True, {"parquet.field.id": c.id} if ids else None) for c in self.schema])


def spark_type(kind) -> T.DataType:
    """The Spark type of an Iceberg type, nested ones included."""
    if isinstance(kind, dict):
        if kind["type"] == "struct":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"]), True) for f in kind["fields"]])
        if kind["type"] == "list":
            return T.ArrayType(spark_type(kind["element"]), True)
        if kind["type"] == "map":
            return T.MapType(spark_type(kind["key"]), spark_type(kind["value"]), True)
        raise IcebergError(f"unknown type {kind}")
    if kind in _PRIMITIVES:
        return _PRIMITIVES[kind]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    if kind.startswith("fixed["):
        return T.BinaryType()
    raise IcebergError(f"unknown type {kind}")


def latest_metadata(names: list[str]) -> str:
    """The metadata file with the highest number (``v10`` is above ``v2``)."""
    numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"v?(\d+)(?:-[0-9a-fA-F-]+)?(?:\.gz)?\.metadata\.json", n))]
    if not numbered:
        raise IcebergError("no metadata file")
    return max(numbered)[1]


def resolve(table: str, path: str, location: str | None = None) -> str:
    """Where a path of the metadata is now, for a table that stands at ``table``.

    Backslashes and Windows drives are normalised; what lies under the recorded location, or starts
    with the table folder's name, is taken relative to ``table``, so copied tables can be read.
    """
    root, path = table.rstrip("/"), path.replace("\\", "/")
    name = root.rsplit("/", 1)[-1]
    if location:
        base = location.replace("\\", "/").rstrip("/")
        if path.startswith(f"{base}/"):
            return f"{root}/{path[len(base) + 1 :]}"
    bare = re.sub(r"^file:/*", "/", path)
    if m := re.match(r"/?([A-Za-z]:/.*)", bare):
        tail = m[1].split(f"/{name}/", 1)
        return f"{root}/{tail[1]}" if len(tail) == 2 else m[1]
    if re.match(r"[a-z][a-z0-9+.-]*://", path) and not path.startswith("file:"):
        return path
    if bare.startswith("/"):
        return bare
    if bare.startswith(f"{name}/"):
        return f"{root}/{bare[len(name) + 1 :]}"
    return f"{root}/{bare.removeprefix('./')}"


def _pairs(value) -> dict:
    """Maps by field id, whether stored as a map or as key-value records."""
    if not value:
        return {}
    if isinstance(value, dict):
        return {int(k): v for k, v in value.items()}
    return {int(x["key"]): x["value"] for x in value}


def _of_partition(transform: str, kind: str, value):
    """The least and the greatest value that a column can have in a partition; None: unknown."""
    unknown = (None, None)
    if value is None or not isinstance(kind, str):
        return unknown
    if transform == "identity":
        if kind in ("float", "double", "binary", "uuid", "timestamptz", "time") or kind.startswith("fixed"):
            return unknown
        if kind == "date" and isinstance(value, int):
            value = datetime.date(1970, 1, 1) + datetime.timedelta(value)
        if kind == "timestamp" and isinstance(value, int):
            value = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=value)
        if kind == "timestamp" and getattr(value, "tzinfo", None):
            return unknown
        return value, value
    if (m := re.fullmatch(r"truncate\[(\d+)\]", transform)) and kind in ("int", "long") and isinstance(value, int):
        return value, value + int(m[1]) - 1
    if transform in ("year", "month", "day", "hour") and kind in ("date", "timestamp"):
        if isinstance(value, datetime.date):  # days may be stored as dates
            value = (value - datetime.date(1970, 1, 1)).days
        if transform in ("year", "month"):
            months = value * (12 if transform == "year" else 1)
            edges = [datetime.datetime(1970 + x // 12, x % 12 + 1, 1) for x in (months, months + (12 if transform == "year" else 1))]
        else:
            step = datetime.timedelta(**{f"{transform}s": 1})
            edges = [datetime.datetime(1970, 1, 1) + value * step, datetime.datetime(1970, 1, 1) + (value + 1) * step]
        if kind == "date":
            return (edges[0].date(), (edges[1] - datetime.timedelta(days=1)).date()) if transform != "hour" else unknown
        return edges[0], edges[1] - datetime.timedelta(microseconds=1)
    return unknown


def data_file(entry: dict, columns: list[Column], specs: list[dict] = ()) -> DataFile | None:
    """The file of a manifest entry, or None if it is deleted. What the entry has no bounds of gets them from
    the file's partition, by the transforms of the table's specs."""
    if entry.get("status", 1) == DELETED:
        return None
    raw = entry["data_file"]
    if raw.get("content", 0):
        raise IcebergError("tables with delete files can't be read")
    lower, upper, nulls, nans = (_pairs(raw.get(k)) for k in ("lower_bounds", "upper_bounds", "null_value_counts", "nan_value_counts"))
    stats = FileStats(records=raw.get("record_count"))
    for c in columns:
        if not isinstance(c.type, str):
            continue
        stats.types[c.name] = c.type
        for to, found in ((stats.lower, lower), (stats.upper, upper)):
            if (value := decode_bound(c.type, found.get(c.id))) is not None:
                to[c.name] = value
        for to, found in ((stats.nulls, nulls), (stats.nans, nans)):
            if c.id in found:
                to[c.name] = found[c.id]
    by_name: dict[str, list] = {}
    for spec in specs:
        for f in spec.get("fields", []):
            if f not in by_name.setdefault(f["name"], []):
                by_name[f["name"]].append(f)
    for name, value in (raw.get("partition") or {}).items():
        fields = by_name.get(name, [])
        if len({(f["source-id"], f["transform"]) for f in fields}) != 1:
            continue  # no spec has it, or specs differ
        c = next((c for c in columns if c.id == fields[0]["source-id"]), None)
        if c is not None:
            for to, bound in zip((stats.lower, stats.upper), _of_partition(fields[0]["transform"], c.type, value), strict=True):
                if bound is not None:
                    to.setdefault(c.name, bound)
    return DataFile(raw["file_path"], str(raw.get("file_format", "PARQUET")).upper(), stats)


@dataclass
class IcebergTable:
    spark: SparkSession
    path: str
    metadata: Metadata
    #: Of each snapshot: the files, and the manifests that the driver hasn't read, being many.
    listed: dict = field(default_factory=dict, repr=False)
    with_ids: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IcebergTable:
        folder = f"{path.rstrip('/')}/metadata"
        return cls(spark, path, Metadata.parse(files.read(spark, f"{folder}/{latest_metadata(files.names(spark, folder))}")))

    def _resolve(self, path: str) -> str:
        return resolve(self.path, path, self.metadata.location)

    def _read(self, path: str) -> bytes:
        where = self._resolve(path)
        if not files.exists(self.spark, where):
            raise IcebergError(f"missing file: {where}")
        return files.read(self.spark, where)

    def files(self, snapshot_id: int | None = None, predicate=None) -> list[DataFile]:
        """The live data files of a snapshot that ``predicate`` can't skip. Manifests may be listed in
        Avro or JSON, or be the list itself. Of many manifests, executors read and prune the entries."""
        snapshot = self.metadata.snapshot(snapshot_id)
        if snapshot is None:
            return []
        known = snapshot["snapshot-id"]
        if known not in self.listed:
            self.listed[known] = self._list(snapshot)
        found, manifests = self.listed[known]
        kept = [x for x in found if not skip(x.stats, predicate)]
        return kept + (self._pruned_by_executors(manifests, predicate) if manifests else [])

    def _list(self, snapshot: dict) -> tuple[list[DataFile], list[str]]:
        columns, specs = self.metadata.schema, self.metadata.specs
        if "manifest-list" in snapshot:
            listed = self._read(snapshot["manifest-list"])
        else:  # v1 tables may name their manifests directly
            listed = json.dumps([{"manifest_path": x} for x in snapshot.get("manifests", [])]).encode()
        found: list[DataFile | None] = []
        manifests: list[str] = []
        rows = json.loads(listed) if listed.lstrip()[:1] == b"[" else list(records(listed))
        for row in rows:
            if "data_file" in row:
                found.append(data_file(row, columns, specs))
                continue
            if row.get("content", 0):
                raise IcebergError("tables with delete files can't be read")
            where = row["manifest_path"]
            if where.lower().endswith((".parquet", ".orc")):
                found.append(DataFile(where, where.rsplit(".", 1)[1].upper(), FileStats(records=row.get("added_rows_count"), types={c.name: c.type for c in columns if isinstance(c.type, str)})))
            else:
                manifests.append(where)
        if len(manifests) <= FEW_MANIFESTS:
            for where in manifests:
                found += [data_file(x, columns, specs) for x in records(self._read(where))]
            manifests = []
        return [x for x in found if x], manifests

    def _pruned_by_executors(self, manifests: list[str], predicate) -> list[DataFile]:
        columns, specs = self.metadata.schema, self.metadata.specs

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    live = [x for e in records(content.as_py()) if (x := data_file(e, columns, specs)) and not skip(x.stats, predicate)]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path for x in live], pa.string()), pa.array([x.format for x in live], pa.string()), pa.array([x.stats.records for x in live], pa.int64())], names=["path", "format", "records"])

        content = self.spark.read.format("binaryFile").load([self._resolve(x) for x in manifests]).select("content")
        return [DataFile(x.path, x.format, FileStats(records=x.records)) for x in content.mapInArrow(read, "path string, format string, records bigint").collect()]

    def scan(self, predicate=None, snapshot_id: int | None = None) -> DataFrame:
        """The table's rows, without the files that ``predicate`` (of ``plans.predicate``) can skip."""
        kept = self.files(snapshot_id, predicate)
        if not kept:
            return self.spark.createDataFrame([], self.metadata.struct)
        if other := {x.format for x in kept} - {"PARQUET"}:
            raise IcebergError(f"unsupported file format: {', '.join(sorted(other))}")
        paths = [self._resolve(x.path) for x in kept]
        # renamed columns are found by id in files that have ids; columns that a file lacks are null
        unknown = [x for x in paths if x not in self.with_ids]
        with ThreadPoolExecutor(16) as pool:
            self.with_ids.update(zip(unknown, pool.map(lambda x: has_field_ids(self.spark, x), unknown), strict=True))
        out = None
        for ids in (True, False):
            if own := [x for x in paths if self.with_ids[x] == ids]:
                if ids:  # only has to do with schemas that name ids, as this one
                    self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
                part = self.spark.read.schema(self.metadata.struct_of(ids)).parquet(*own)
                out = part if out is None else out.unionByName(part)
        return out
