import os

import pytest

from loam.cli import answer
from loam.display import cell, table
from loam.engine import Engine
from loam.operators import relational as R


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('p')}/people.parquet"
    spark.createDataFrame([(1, 20, "a"), (2, 30, None), (3, 25, "c"), (4, 40, "d"), (5, None, "e")], "id bigint, age int, name string").coalesce(1).write.parquet(path)
    return path


def ids(df):
    return [r.id for r in df.collect()]


def test_filters_and_nulls(spark, people):
    e = Engine(spark)
    e.connect(people)
    assert ids(e.sql("SELECT id WHERE age > 25 ORDER BY id")) == [2, 4]
    assert ids(e.sql("SELECT id, age WHERE age >= 25 AND id <= 3 ORDER BY id")) == [2, 3]
    assert ids(e.sql("SELECT id WHERE NOT age > 25 ORDER BY id")) == [1, 3]
    assert e.sql("SELECT count(*) AS a, count(age) AS b, sum(age) AS c, min(name) AS d").first() == (5, 4, 115, "a")
    assert e.sql("SELECT sum(age) AS s, count(age) AS n WHERE id > 9").first() == (None, 0)
    assert e.sql("SELECT age, id").columns == ["age", "id"]
    assert ids(e.sql("SELECT id ORDER BY age DESC NULLS LAST, id LIMIT 2 OFFSET 1")) == [2, 3]


def test_errors(spark, people):
    e = Engine(spark)
    e.connect(people)
    for text in ("SELECT missing", "SELECT id WHERE nothing = 1", "DELETE FROM x", "SELECT id ORDER BY id LIMIT 1 nonsense more"):
        with pytest.raises(Exception):
            e.sql(text).collect()
    with pytest.raises(ValueError):
        Engine(spark).info()


def test_console(spark, people):
    e = Engine(spark)
    assert answer(e, f"\\c {people}").endswith("(parquet)")
    assert "age int" in answer(e, "\\schema") and "kind: parquet" in answer(e, "\\d")
    assert answer(e, "\\refresh") == "refreshed" and "SELECT" in answer(e, "help")
    assert answer(e, "exit") is None and answer(e, "") == "" and answer(e, "head 5").startswith("head is no command")
    assert "(2 rows)" in answer(e, "SELECT id WHERE age > 25")
    assert answer(e, "SELECT nope").startswith("error:")
    many = "SELECT a.id FROM people.parquet a CROSS JOIN people.parquet b"
    e = Engine(spark, os.path.dirname(people))
    assert "(25 rows total, showing 10)" in answer(e, many) and "(25 rows)" in answer(e, f"full {many}")


def test_cells():
    assert [cell(x) for x in (None, True, 1.005, 3, "x" * 60)] == ["NULL", "true", "1.00", "3", "x" * 47 + "..."]
    assert table(["a"], [(1,)]).endswith("(1 row)")


def test_relational(spark, people):
    df = spark.read.parquet(people)
    assert ids(R.order(R.where(df, "age > 20"), df.id.desc(), limit=2)) == [4, 3]
    assert R.aggregate(df, ["name"]).count() == 5
    assert R.join(df, df.limit(2), None, "cross").count() == 10
    assert [r.i for r in R.ranked(df, [], [df.id], i="row_number").collect()] == [1, 2, 3, 4, 5]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "a int, b double").write.parquet(f"{tmp_path}/e.parquet")
    e = Engine(spark)
    e.connect(f"{tmp_path}/e.parquet")
    assert e.sql("SELECT count(*) AS n, max(b) AS m").first() == (0, None)
    assert e.sql("SELECT a, count(*) AS n GROUP BY a").count() == 0 and "(0 rows)" in e.show("SELECT *")
