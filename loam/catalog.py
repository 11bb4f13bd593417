"""Queries of the engine, one for each operator, with their SQL for a second engine.

Sums of doubles are made in decimals so that they don't depend on the order of rows, integer sums
are cast to BIGINT, and LIMIT always follows a sort by a unique key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.aggregates import exact_sum
from .operators import relational as R
from .plans.dialect import tokens

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Read alike by Spark and by the second engine.
SQL = {
    "scan_star": "SELECT * FROM nation",
    "select_columns": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "filter_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_ne": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority != '5-LOW'",
    "filter_lt": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10",
    "filter_le": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 10",
    "filter_gt": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40",
    "filter_ge": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 40",
    "filter_col_vs_col": "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax",
    "filter_cross_type": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 2.5",
    "filter_string": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'",
    "filter_and_or_not": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE NOT o_orderstatus = 'O' AND o_totalprice > 1000 OR o_orderkey < 100",
    "filter_parens": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 1000 OR o_orderkey < 100)",
    "filter_bool_literal": "SELECT n_nationkey, n_name FROM nation WHERE TRUE AND NOT FALSE",
    "filter_boolean_column": "SELECT n_nationkey FROM (SELECT n_nationkey, n_regionkey = 1 AS flag FROM nation) x WHERE flag",
    "filter_null_literal": "SELECT n_nationkey, n_name, n_nationkey = NULL AS unknown, NULL IS NULL AS yes, coalesce(NULL, n_regionkey) AS k FROM nation WHERE n_nationkey = NULL OR n_regionkey = 1",
    "filter_timestamp": "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-02-01 00:00:00'",
    "is_null": "SELECT c_custkey, c_segment IS NULL AS without_segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_segment, c_acctbal FROM customer) x WHERE c_segment IS NULL OR c_acctbal > 9000",
    "is_not_null": "SELECT count(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS c_segment FROM customer) x WHERE c_segment IS NOT NULL",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)",
    "between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'x_%'",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 2 AS s, l_linenumber * 3 AS m, l_linenumber / 4 AS d, l_linenumber % 5 AS r FROM lineitem",
    "unary_minus": "SELECT o_orderkey, -o_totalprice AS negated FROM orders WHERE -o_totalprice < -1000",
    "alias": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders",
    "qualified_column": "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_custkey < 50",
    "function_call": "SELECT c_custkey, upper(c_mktsegment) AS segment, length(c_name) AS n FROM customer",
    "case_when": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS amount FROM lineitem",
    "comments_and_case": "select /* all */ o_orderkey -- the key\nFrOm orders WhErE o_orderkey <= 10",
    "count_star": "SELECT count(*) AS n FROM lineitem",
    "count_col": "SELECT count(nullif(l_returnflag, 'R')) AS n, count(*) AS n_rows, count(l_shipdate) AS n_dates FROM lineitem",
    "sum": "SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem",
    "avg": "SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS by_sum, avg(l_linenumber) AS number FROM lineitem",
    "min": "SELECT min(l_extendedprice) AS price, min(l_shipdate) AS day, min(l_returnflag) AS flag FROM lineitem",
    "max": "SELECT max(l_extendedprice) AS price, max(l_shipdate) AS day, max(l_returnflag) AS flag FROM lineitem",
    "multi_agg": "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders",
    "agg_empty": "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, min(o_totalprice) AS low FROM orders WHERE o_orderkey < 0",
    "agg_where": "SELECT count(*) AS n, max(l_quantity) AS most FROM lineitem WHERE l_discount > 0.05",
    "group_by_one": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag",
    "group_by_two": "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_no_agg": "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_where": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value > 10 GROUP BY event_type",
    "agg_expression_arg": "SELECT o_orderstatus, max(o_totalprice * 2 + 1) AS most FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "distinct": "SELECT DISTINCT o_orderpriority FROM orders",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS customers FROM orders",
    "group_order_limit": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 7",
    "order_asc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey",
    "order_desc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC",
    "order_multi": "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_orderkey",
    "limit": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "offset_only": "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_full": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)",
    "join_three": "SELECT r_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS i FROM orders",
    "window_dense_rank": "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS i FROM orders",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey",
    "subquery_in": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "subquery_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "subquery_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "boolean_equal": "SELECT n_nationkey, flag <> even AS differ FROM (SELECT n_nationkey, n_regionkey = 1 AS flag, n_nationkey % 2 = 0 AS even FROM nation) x WHERE flag = even OR flag = TRUE",
    "boolean_not_equal": "SELECT n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 3) = 1 AS flag FROM nation) x WHERE flag <> FALSE OR flag != TRUE",
    "not_over_null": "SELECT n_nationkey, NOT (k = 1) AS other FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x WHERE NOT (k = 1) OR n_nationkey < 5",
    "null_logic": "SELECT n_nationkey, k = 1 AND n_nationkey < 9 AS conj, k = 1 OR n_nationkey < 9 AS disj FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x",
    "not_in_null": "SELECT n_nationkey, k IN (1, 2) AS inside, k NOT IN (1, NULL) AS outside FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x",
    "group_by_null": "SELECT c_segment, count(*) AS n, count(c_segment) AS named, max(c_acctbal) AS most FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS c_segment, c_acctbal FROM customer) x GROUP BY c_segment",
    "agg_nulls": "SELECT count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high, avg(k) AS mean FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x",
    "distinct_null": "SELECT DISTINCT k FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x",
    "order_nulls": "SELECT n_nationkey, k FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x ORDER BY k DESC NULLS FIRST, n_nationkey LIMIT 9",
    "nan_order": "SELECT k, x > 1e300 AS above, x = CAST('NaN' AS DOUBLE) AS same FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN CAST('NaN' AS DOUBLE) ELSE n_regionkey * 1.5 END AS x FROM nation) y ORDER BY x DESC, k LIMIT 12",
    "nan_groups": "SELECT count(*) AS n, count(DISTINCT x) AS kinds, max(x) = CAST('NaN' AS DOUBLE) AS most FROM (SELECT CASE WHEN n_regionkey = 2 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_regionkey AS DOUBLE) END AS x FROM nation) y",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS overall FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "window_frames": "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS total, lag(o_orderkey) OVER d AS previous, lead(o_orderkey, 2) OVER d AS later, CAST(ntile(4) OVER d AS INT) AS quarter FROM orders WINDOW d AS (PARTITION BY o_custkey ORDER BY o_orderkey), w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "distinct_from": "SELECT n_nationkey, k IS DISTINCT FROM 1 AS other FROM (SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation) x WHERE k IS NOT DISTINCT FROM NULL OR k IS DISTINCT FROM 2",
    "quoted_name": "SELECT n_nationkey, 'it''s' AS said FROM nation WHERE concat(n_name, 'x''s') <> 'it''s' AND n_name > 'A'",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)",
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tables are views of names of their own, so queries over several folders don't meet."""
        mark, out = uuid.uuid4().hex[:8], []
        for x in tokens(text):
            if x.kind == "word" and x.text in TABLES:
                name = f"{x.text}_{mark}"
                spark.read.parquet(f"{sf_dir}/{x.text}.parquet").createOrReplaceTempView(name)
                out.append(name)
            else:
                out.append(x.text)
        return Engine(spark).sql("".join(out))

    return run


def _connected(table: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.connect(f"{sf_dir}/{table}.parquet")
        return engine.sql(text)

    return run


def _files(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).sql(text.replace("{dir}", sf_dir))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _connected("lineitem", FLAGSHIP.replace(" FROM lineitem", ""))(spark, sf_dir)


FLAGSHIP = "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS avg_quantity FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag ORDER BY l_returnflag"


def dataframe_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, join, aggregate, rank and top-k through the DataFrame functions."""
    orders = R.where(_table(spark, sf_dir, "orders"), F.col("o_orderstatus") != "P")
    joined = R.join(orders, _table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = R.aggregate(joined, ["c_mktsegment", "o_orderpriority"], F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total"), having="n > 1")
    placed = R.ranked(totals, ["c_mktsegment"], [F.col("total").desc(), F.col("o_orderpriority")], place="row_number")
    return R.order(R.project(placed, "c_mktsegment", "o_orderpriority", "n", "total", "place"), F.col("total").desc(), F.col("c_mktsegment"), F.col("o_orderpriority"), limit=12)


DATAFRAME_API = """SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, o_orderpriority) AS place FROM (
SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment, o_orderpriority HAVING count(*) > 1) ORDER BY total DESC, c_mktsegment, o_orderpriority LIMIT 12"""

#: Queries that only this engine's dialect has, with the SQL that says the same.
OWN = {
    "flagship": (flagship, FLAGSHIP),
    "dataframe_api": (dataframe_api, DATAFRAME_API),
    "fromless_connection": (_connected("orders", "SELECT o_orderstatus, count(*) AS n WHERE o_totalprice > 1000 GROUP BY o_orderstatus"), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"),
    "fromless_star": (_connected("region", "SELECT *"), "SELECT * FROM region"),
    "from_quoted_path": (_files("SELECT p_partkey, p_size FROM '{dir}/part.parquet' WHERE p_size < 5"), "SELECT p_partkey, p_size FROM part WHERE p_size < 5"),
    "from_file_name": (_files("SELECT n_name, r_name FROM nation.parquet n JOIN region.parquet r ON n.n_regionkey = r.r_regionkey"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_semi": (_sql("SELECT s_suppkey FROM supplier LEFT SEMI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) n ON s_nationkey = n_nationkey"), "SELECT s_suppkey FROM supplier SEMI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) n ON s_nationkey = n_nationkey"),
    "join_anti": (_sql("SELECT s_suppkey FROM supplier LEFT ANTI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) n ON s_nationkey = n_nationkey"), "SELECT s_suppkey FROM supplier ANTI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) n ON s_nationkey = n_nationkey"),
    "from_file_list": (_files("SELECT n_name, r_name FROM '{dir}/nation.parquet' n, region.parquet r WHERE n.n_regionkey = r.r_regionkey"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "fromless_set": (_connected("nation", "SELECT n_regionkey AS k WHERE n_nationkey < 9 UNION ALL SELECT n_nationkey WHERE n_regionkey = (SELECT max(n_regionkey))"), "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 9 UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)"),
    "head": (lambda spark, sf_dir: Engine(spark).head(f"{sf_dir}/region.parquet", 10), "SELECT * FROM region"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import lake

    return {k: _sql(v) for k, v in SQL.items()} | {k: v[0] for k, v in OWN.items()} | lake.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import lake

    return SQL | {k: v[1] for k, v in OWN.items()} | lake.ORACLE_SQL
