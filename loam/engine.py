"""Connections and queries."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import display
from .plans.conditions import conditions, depends_on_the_clock, locations
from .plans.dialect import named, rewrite
from .sources import detect, files
from .sources.avro_source import read_avro
from .sources.iceberg import IcebergTable
from .sources.parquet import read_parquet

_numbers = itertools.count()


@dataclass
class Connection:
    """A path with its kind and the view that stands for it."""

    path: str
    kind: str
    view: str
    iceberg: IcebergTable | None = None
    frame: DataFrame | None = None


class Engine:
    """SQL over Parquet files, Avro files and Iceberg tables.

    ``connect`` to a path and leave FROM out, or name paths in FROM. Everything else is Spark SQL:
    Catalyst parses, optimises and runs it. Results are lazy DataFrames.
    """

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark, self.base, self.connection = spark, base, None
        self.views: dict[str, Connection] = {}

    def connect(self, path: str) -> Connection:
        """Makes ``path`` the table of queries without FROM."""
        self.connection = self._open(path)
        return self.connection

    def refresh(self) -> Connection:
        """Reads the connection's metadata anew."""
        if not self.connection:
            raise ValueError("not connected")
        self.views.pop(self.connection.path, None)
        self.spark.catalog.refreshByPath(self.connection.path)
        return self.connect(self.connection.path)

    def sql(self, text: str) -> DataFrame:
        """The result of a query."""
        if self._word(text) not in ("SELECT", "WITH"):
            raise ValueError("only SELECT queries are supported")
        bound = rewrite(text, self.connection.view if self.connection else None, lambda name: self._open(name).view)
        narrow = {}
        for c in self.views.values():
            if c.kind == detect.AVRO and c.view in bound and (used := named(bound, c.frame.columns)) is not None and len(used) < len(c.frame.columns):
                narrow[c.view] = c.frame
                read_avro(self.spark, c.path, used).createOrReplaceTempView(c.view)
        try:
            return self._pruned(self.spark.sql(bound), bound)
        finally:
            for view, frame in narrow.items():
                frame.createOrReplaceTempView(view)

    def show(self, text: str, full: bool = False) -> str:
        """A query's result as a console table; ``full SELECT ...`` shows all rows."""
        if self._word(text) == "FULL":
            text, full = text.strip()[4:], True
        return display.show(self.sql(text), full)

    def head(self, path: str, n: int = 10) -> DataFrame:
        return self.spark.table(self._open(path).view).limit(n)

    def schema(self) -> T.StructType:
        if not self.connection:
            raise ValueError("not connected")
        return self.spark.table(self.connection.view).schema

    def info(self) -> dict:
        """What is known of the connection without reading its data."""
        c = self.connection
        if not c:
            raise ValueError("not connected")
        out = {"path": c.path, "kind": c.kind, "columns": len(self.schema())}
        if c.iceberg:
            m, now = c.iceberg.metadata, c.iceberg.metadata.snapshot()
            out |= {"format_version": m.version, "snapshots": len(m.snapshots), "snapshot_id": m.current_snapshot, "summary": (now or {}).get("summary", {}), "files": len(c.iceberg.files())}
        return out

    @staticmethod
    def _word(text: str) -> str:
        from .plans.dialect import tokens

        return next((x.upper for x in tokens(text) if x.kind != "space"), "")

    def _where(self, name: str) -> str:
        if self.base and "://" not in name and not name.startswith("/") and not files.exists(self.spark, name):
            return f"{self.base.rstrip('/')}/{name}"
        return name

    def _open(self, name: str) -> Connection:
        path = self._where(name)
        if path not in self.views:
            kind = detect.detect(self.spark, path)
            made = Connection(path, kind, f"loam_{next(_numbers)}")
            if kind == detect.ICEBERG:
                made.iceberg = IcebergTable.load(self.spark, path)
            made.frame = self._frame(made)
            made.frame.createOrReplaceTempView(made.view)
            self.views[path] = made
        return self.views[path]

    def _frame(self, c: Connection) -> DataFrame:
        if c.kind == detect.PARQUET:
            return read_parquet(self.spark, c.path)
        if c.kind == detect.AVRO:
            return read_avro(self.spark, c.path)
        return c.iceberg.scan()

    def _pruned(self, df: DataFrame, text: str) -> DataFrame:
        """The query over fewer files: of each Iceberg table in it, those that the filters which Catalyst
        brings down to the table can't skip. A table used twice keeps what either use needs."""
        tables = [c for c in self.views.values() if c.iceberg and c.view in text]
        if not tables or depends_on_the_clock(text):
            return df
        found, changed = conditions(df, tuple({f.name for c in tables for f in c.frame.schema if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))})), []
        for c in tables:
            own = locations(c.frame)
            trees = [tree for where, tree in found if any(where.equals(x) for x in own)]
            if trees and all(trees):
                tree = functools.reduce(lambda a, b: ("or", a, b), trees)
                c.iceberg.scan(tree).createOrReplaceTempView(c.view)
                changed.append(c)
        if changed:
            try:
                return self.spark.sql(text)
            finally:
                for c in changed:
                    c.frame.createOrReplaceTempView(c.view)
        return df
