import datetime
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.engine import Engine
from loam.lake import container, encode, write_avro, write_iceberg
from loam.sources import detect
from loam.sources.avro_codec import AvroError, header, records
from loam.sources.iceberg import Column, IcebergError, IcebergTable, Metadata, data_file, latest_metadata, resolve
from loam.sources.parquet import footer
from loam.sources.pruning import skip

ROW = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": ["double", "null"]}, {"name": "d", "type": {"type": "array", "items": "int"}}, {"name": "e", "type": {"type": "map", "values": "boolean"}}, {"name": "f", "type": "float"}, {"name": "g", "type": "bytes"}]}
VALUES = st.fixed_dictionaries({"a": st.integers(-(2**63), 2**63 - 1), "b": st.none() | st.text(), "c": st.none() | st.floats(allow_nan=False), "d": st.lists(st.integers(-(2**31), 2**31 - 1), max_size=3), "e": st.dictionaries(st.text(max_size=3), st.booleans(), max_size=3), "f": st.floats(width=32, allow_nan=False), "g": st.binary(max_size=5)})


@given(st.lists(VALUES, max_size=7), st.sampled_from(["null", "deflate"]))
def test_avro_round_trip(rows, codec):
    assert list(records(container(ROW, rows, block=2, codec=codec))) == rows


def test_avro_varints():
    assert [encode("long", n) for n in (0, -1, 1, -2, 64)] == [b"\0", b"\1", b"\2", b"\3", b"\x80\x01"]


def test_avro_errors():
    good = container(ROW, [])
    with pytest.raises(AvroError):
        header(b"nope" + good[4:])
    with pytest.raises(AvroError):
        list(records(good.replace(b"null", b"lzma", 1)))
    one = container({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}]}, [{"a": 1}])
    with pytest.raises(AvroError):
        list(records(one[:-1] + b"\xff"))


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(
        [(1, 10, 1.5, "a", True), (2, None, float("nan"), None, None), (3, 30, None, "c", False), (4, 40, -2.0, "é", True)],
        "id bigint, i int, d double, s string, b boolean",
    )


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_files(spark, typed, tmp_path, codec):
    write_avro(typed, f"{tmp_path}/t.avro", codec)
    engine = Engine(spark)
    engine.connect(f"{tmp_path}/t.avro")
    assert rows(engine.sql("SELECT *")) == rows(typed)
    assert engine.sql("SELECT count(i) AS n, sum(i) AS s WHERE b").first() == (2, 50)
    assert [f.dataType.simpleString() for f in engine.schema()] == ["bigint", "int", "double", "string", "boolean"]


def test_avro_is_split_and_narrow(spark, tmp_path, monkeypatch):
    import loam.sources.avro_source as module

    df = spark.range(5000).selectExpr("id", "concat('n', id) AS name", "CAST(id % 7 AS int) AS k", "CAST(IF(id % 3 = 0, NULL, id * 0.5) AS double) AS x").coalesce(1)
    write_avro(df, f"{tmp_path}/t.avro", "deflate", block=100)
    assert len([x for x in (tmp_path / "t.avro").iterdir() if x.suffix == ".avro"]) == 1
    whole = rows(df)
    for size in (100, 999, 7000, 10**9):
        monkeypatch.setattr(module, "RANGE", size)
        got = module.read_avro(spark, f"{tmp_path}/t.avro")
        assert rows(got) == whole
        if size == 999:
            assert got.rdd.getNumPartitions() > 10 and got.rdd.glom().filter(len).count() > 5
    engine = Engine(spark)
    engine.connect(f"{tmp_path}/t.avro")
    narrow = engine.sql("SELECT k, count(*) AS n, max(x) AS most WHERE K < 3 GROUP BY k")
    assert rows(narrow) == rows(df.where("k < 3").groupBy("k").agg({"*": "count", "x": "max"}).select("k", "count(1)", "max(x)"))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "name#" not in plan and "MapInArrow" in plan
    assert engine.sql("SELECT count(*) AS n").first().n == 5000 and "name#" not in engine.sql("SELECT count(*) AS n")._jdf.queryExecution().analyzed().toString()
    assert engine.sql("SELECT *").columns == df.columns
    monkeypatch.setattr(module, "opened", lambda path: None)
    assert rows(module.read_avro(spark, f"{tmp_path}/t.avro", ["x", "id"])) == rows(df.select("x", "id"))


@given(st.lists(VALUES, max_size=9), st.sets(st.sampled_from("abcdefg")), st.integers(1, 80))
def test_avro_ranges_and_columns(data, wanted, size):
    from loam.sources.avro_codec import CODECS, Reader, blocks, columns_reader

    raw, wanted = container(ROW, data, block=2), sorted(wanted)
    out = [[] for _ in wanted]
    for begin in range(0, len(raw), size):
        for schema, codec, count, block in blocks(io.BytesIO(raw), begin, begin + size):
            read, r = columns_reader(schema, wanted), Reader(CODECS[codec](block))
            for _ in range(count):
                read(r, out)
            assert r.at == len(r.data)
    assert out == [[row[c] for row in data] for c in wanted]


def test_empty_avro_and_nested(spark, tmp_path):
    (tmp_path / "e.avro").write_bytes(container(ROW, []))
    (tmp_path / "n.avro").write_bytes(container(ROW, [{"a": 1, "b": None, "c": 2.0, "d": [1, 2], "e": {"k": True}, "f": 0.5, "g": b"x"}]))
    assert Engine(spark).head(f"{tmp_path}/e.avro").count() == 0
    row = Engine(spark, str(tmp_path)).sql("SELECT d[1] AS d, e['k'] AS e, b FROM 'n.avro'").first()
    assert tuple(row) == (2, True, None)


def test_avro_written_by_the_jvm(spark, tmp_path):
    """An independent writer: the library that ships with Spark."""
    jvm = spark.sparkContext._jvm
    text = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "s", "type": ["string", "null"]}]})
    schema = jvm.org.apache.avro.Schema.Parser().parse(text)
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
    for codec in ("null", "deflate", "snappy", "bzip2"):
        path = f"{tmp_path}/{codec}.avro"
        writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
        writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString(codec))
        writer.create(schema, jvm.java.io.File(path))
        for i in range(5):
            r = jvm.org.apache.avro.generic.GenericData.Record(schema)
            r.put("a", jvm.java.lang.Long.valueOf(i))
            r.put("s", f"x{i}" if i % 2 else None)
            writer.append(r)
        writer.close()
        assert rows(Engine(spark).head(path)) == rows(spark.createDataFrame([(i, f"x{i}" if i % 2 else None) for i in range(5)], "a bigint, s string"))


def test_detection(spark, typed, tmp_path):
    typed.write.parquet(f"{tmp_path}/p")
    part = next((tmp_path / "p").glob("*.parquet"))
    (tmp_path / "bare").write_bytes(part.read_bytes())
    (tmp_path / "abare").write_bytes(container(ROW, []))
    (tmp_path / "bad").write_bytes(b"12345678")
    assert detect.detect(spark, f"{tmp_path}/p") == detect.detect(spark, f"{tmp_path}/bare") == detect.PARQUET
    assert detect.detect(spark, f"{tmp_path}/abare") == detect.AVRO
    for wrong in ("bad", "missing"):
        with pytest.raises(detect.UnknownSource):
            detect.detect(spark, f"{tmp_path}/{wrong}")
    assert footer(spark, str(part))["columns"] == 5


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    df = spark.range(200).selectExpr("id", "CAST(id * 0.5 AS double) AS price", "CAST(id % 7 AS int) AS k", "concat('n', id) AS name", "IF(id % 50 = 0, NULL, id) AS gap")
    return write_iceberg(df, f"{tmp_path_factory.mktemp('lake')}/t", parts=5, by="id"), df


def test_iceberg_reads_and_prunes(spark, lake):
    path, df = lake
    engine = Engine(spark)
    engine.connect(path)
    assert rows(engine.sql("SELECT *")) == rows(df)
    assert engine.info()["files"] == 5
    for where in ("id < 30", "price > 80.5 AND k = 3", "name = 'n7'", "gap IS NULL", "id IN (1, 199)", "NOT id < 190", "40 > id OR price >= 99"):
        pruned = engine.sql(f"SELECT * WHERE {where}")
        assert rows(pruned) == rows(df.where(where))
    assert len(engine.sql("SELECT * WHERE id < 30").inputFiles()) == 1
    assert len(engine.sql("SELECT * WHERE price < 0").inputFiles()) == 0
    assert len(engine.sql("SELECT * WHERE NOT id < 190").inputFiles()) == 1
    assert len(engine.sql("SELECT *").inputFiles()) == 5


def test_iceberg_prunes_wherever_filters_get_to(spark, lake):
    path, df = lake
    engine = Engine(spark)
    engine.connect(path)
    files = lambda text: len(engine.sql(text).inputFiles())
    assert files(f"SELECT a.id FROM '{path}' a JOIN (SELECT 7 AS x) b ON a.id = b.x WHERE a.id < 30") == 1
    assert files("WITH q AS (SELECT id, k) SELECT * FROM q WHERE id BETWEEN 1 AND 5") == 1
    assert files("SELECT count(*) FROM (SELECT id AS i, price) WHERE i > 190") == 1
    assert files("SELECT id WHERE id < 30 UNION ALL SELECT id WHERE id > 190") == 2
    assert files(f"SELECT a.id FROM '{path}' a, '{path}' b WHERE a.id = b.k AND a.id < 5") == 5
    assert files("SELECT * WHERE id < 30 + extract(YEAR FROM current_date())") == 5
    assert rows(engine.sql("SELECT id WHERE id < 30 UNION ALL SELECT id WHERE id > 190")) == rows(df.where("id < 30 OR id > 190").select("id"))


def test_quotes_zones_and_nested_fields_lose_no_rows(spark, tmp_path):
    df = spark.sql("SELECT id, IF(id % 2 = 0, 'it''s', concat('n', id)) AS name, TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(id) AS ts FROM range(60)")
    path = write_iceberg(df, f"{tmp_path}/q", parts=4, by="id")
    engine = Engine(spark)
    engine.connect(path)
    for where in ("name = 'it''s'", "name <> 'it''s'", "ts >= TIMESTAMP '2020-01-05 00:00:00Z'", "ts < TIMESTAMP_NTZ '2020-01-05 00:00:00'", "name IS DISTINCT FROM 'n3'", "extract(DAY FROM ts) = 3"):
        assert rows(engine.sql(f"SELECT * WHERE {where}")) == rows(df.where(where)), where
    assert len(engine.sql("SELECT * WHERE ts < TIMESTAMP_NTZ '2020-01-05 00:00:00'").inputFiles()) == 1


_LITERALS = {"id": st.integers(-5, 210).map(str), "price": st.sampled_from(["0.5", "17", "1e2", "99.5D"]), "name": st.sampled_from(["'n7'", "'it''s'", "''", "'n\\\\x'", "\"n19\""]), "k": st.integers(-1, 8).map(str), "gap": st.just("150")}
_CONDITIONS = st.recursive(
    st.sampled_from(list(_LITERALS)).flatmap(lambda c: st.one_of(st.tuples(st.just(c), st.sampled_from(["<", "<=", ">", ">=", "=", "<>", "IS DISTINCT FROM"]), _LITERALS[c]).map(" ".join), st.sampled_from([f"{c} IS NULL", f"{c} IS NOT NULL"]), st.tuples(_LITERALS[c], _LITERALS[c]).map(lambda v, c=c: f"{c} BETWEEN {v[0]} AND {v[1]}"), st.lists(_LITERALS[c], min_size=1, max_size=3).map(lambda v, c=c: f"{c} IN ({', '.join(v)})"))),
    lambda t: st.one_of(st.tuples(t, st.sampled_from(["AND", "OR"]), t).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), t.map(lambda x: f"NOT ({x})")),
    max_leaves=3,
)


@settings(max_examples=25, deadline=None)
@given(_CONDITIONS)
def test_any_condition_keeps_its_rows(spark, lake, where):
    path, df = lake
    engine = Engine(spark)
    engine.connect(path)
    assert engine.sql(f"SELECT count(*) AS n WHERE {where}").first()[0] == df.where(where).count(), where


def test_partitions_have_bounds():
    columns = [Column(1, "d", "date", False), Column(2, "n", "long", False), Column(3, "s", "string", False), Column(4, "ts", "timestamp", False)]
    spec = lambda name, source, transform: {"name": name, "source-id": source, "transform": transform, "field-id": 1000}
    specs = [{"spec-id": 0, "fields": [spec("d_month", 1, "month"), spec("n_cut", 2, "truncate[10]"), spec("s", 3, "identity"), spec("ts_hour", 4, "hour"), spec("b", 2, "bucket[4]")]}]
    entry = {"status": 1, "data_file": {"file_path": "f", "record_count": 1, "partition": {"d_month": -1, "n_cut": -20, "s": "x", "ts_hour": 25, "b": 3, "other": 1}}}
    found = data_file(entry, columns, specs).stats
    assert found.lower == {"d": datetime.date(1969, 12, 1), "n": -20, "s": "x", "ts": datetime.datetime(1970, 1, 2, 1)}
    assert found.upper == {"d": datetime.date(1969, 12, 31), "n": -11, "s": "x", "ts": datetime.datetime(1970, 1, 2, 1, 59, 59, 999999)}
    assert skip(found, (">", "n", -11)) and not skip(found, ("=", "n", -15)) and skip(found, ("<", "d", datetime.date(1969, 12, 1)))
    assert not data_file(entry, columns, [*specs, {"spec-id": 1, "fields": [spec("s", 2, "identity")]}]).stats.lower.get("s")


def test_many_manifests_are_read_by_executors(spark, lake, monkeypatch):
    import loam.sources.iceberg as module

    path, df = lake
    few = IcebergTable.load(spark, path).files(predicate=("<", "id", 90))
    monkeypatch.setattr(module, "FEW_MANIFESTS", 0)
    t = IcebergTable.load(spark, path)
    assert {x.path for x in t.files(predicate=("<", "id", 90))} == {x.path for x in few} and 0 < len(few) < 5
    assert rows(t.scan()) == rows(df)


@settings(max_examples=15, deadline=None)
@given(st.sampled_from(["id", "price", "k"]), st.sampled_from(["<", "<=", ">", ">=", "=", "<>"]), st.integers(-5, 210))
def test_pruned_answers_are_whole(spark, lake, column, op, value):
    path, df = lake
    engine = Engine(spark)
    engine.connect(path)
    where = f"{column} {op} {value}"
    assert engine.sql(f"SELECT count(*) AS n WHERE {where}").first()[0] == df.where(where).count()


META = {"format-version": 2, "table-uuid": "u", "location": "/t", "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "x", "type": "long", "required": True}, {"id": 2, "name": "y", "type": {"type": "list", "element": "string", "element-id": 3}, "required": False}]}], "snapshots": []}


def test_metadata():
    m = Metadata.parse(json.dumps(META))
    assert (m.version, m.uuid, [c.name for c in m.schema], m.snapshot()) == (2, "u", ["x", "y"], None)
    assert m.struct.simpleString() == "struct<x:bigint,y:array<string>>"
    assert Metadata.parse(json.dumps(META | {"current-snapshot-id": -1})).snapshot() is None
    with pytest.raises(IcebergError):
        Metadata.parse(json.dumps(META | {"current-snapshot-id": 5})).snapshot()
    assert latest_metadata(["v2.metadata.json", "v10.metadata.json", "version-hint.text"]) == "v10.metadata.json"


def test_paths():
    assert resolve("/lake/t", "data/f.parquet") == "/lake/t/data/f.parquet"
    assert resolve("/lake/t", "t\\metadata/m.avro") == "/lake/t/metadata/m.avro"
    assert resolve("/lake/t", "file://e:\\x\\t\\metadata\\m.avro") == "/lake/t/metadata/m.avro"
    assert resolve("/lake/t", "file:///a/b") == "/a/b"
    assert resolve("/lake/t", "s3://bucket/old/t/data/f", "s3://bucket/old/t") == "/lake/t/data/f"
    assert resolve("/lake/t", "s3://bucket/f") == "s3://bucket/f"


def table(folder, list_bytes, snapshot=1):
    (folder / "metadata").mkdir(parents=True)
    meta = META | {"location": str(folder), "current-snapshot-id": snapshot, "snapshots": [{"snapshot-id": 1, "manifest-list": "metadata/list"}]}
    meta["schemas"] = [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "type": "long", "required": False}, {"id": 2, "name": "extra", "type": "string", "required": False}]}]
    (folder / "metadata" / "v1.metadata.json").write_text(json.dumps(meta))
    (folder / "metadata" / "list").write_bytes(list_bytes)
    return str(folder)


def test_json_and_flat_lists(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/x")
    part = next((tmp_path / "x").glob("*.parquet")).read_bytes()
    flat = {"type": "record", "name": "m", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "d", "fields": [{"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}]}}]}
    one = lambda name, status=1: {"status": status, "data_file": {"file_path": name, "file_format": "PARQUET", "record_count": 5}}
    for k, listed in enumerate([b'\r\n[{"manifest_path": "data/f.parquet", "added_rows_count": 5}]', container(flat, [one("data/f.parquet", 0), one("data/gone.parquet", 2)])]):
        folder = tmp_path / f"t{k}"
        path = table(folder, listed)
        (folder / "data").mkdir()
        (folder / "data" / "f.parquet").write_bytes(part)
        assert rows(IcebergTable.load(spark, path).scan()) == rows(spark.range(5).selectExpr("id", "CAST(NULL AS string) AS extra"))


def test_refusals(spark, tmp_path):
    deletes = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    with pytest.raises(IcebergError):
        IcebergTable.load(spark, table(tmp_path / "a", container(deletes, [{"manifest_path": "m", "content": 1}]))).scan()
    with pytest.raises(IcebergError):
        IcebergTable.load(spark, table(tmp_path / "b", b'[{"manifest_path": "gone.avro"}]')).scan()
    empty = IcebergTable.load(spark, table(tmp_path / "c", b"[]", snapshot=None)).scan()
    assert empty.count() == 0 and empty.columns == ["id", "extra"]
