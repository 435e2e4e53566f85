"""One query per operator, run by the engine, with the DuckDB statement that must agree.

Where one text serves both dialects it is given once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import Session
from .sources.catalog import values

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FLAGSHIP = """
SELECT o.o_orderpriority AS priority, COUNT(*) AS n, SUM(l.l_quantity) AS quantity,
       AVG(l.l_extendedprice * (1 - l.l_discount)) AS revenue, STDDEV(l.l_discount) AS spread
FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey
WHERE l.l_discount > 0.05 GROUP BY o.o_orderpriority HAVING COUNT(*) > 10
"""

#: name: statement, or (the engine's, DuckDB's)
SQL: dict[str, str | tuple[str, str]] = {
    # scans and projections
    "scan_all": "SELECT * FROM nation",
    "scan_count": "SELECT COUNT(*) AS n FROM lineitem",
    "project_columns": "SELECT l_orderkey, l_quantity FROM lineitem",
    "project_alias": "SELECT l_quantity AS qty FROM lineitem",
    "project_wildcard_mixed": "SELECT n_name AS nm, nation.* FROM nation",
    "project_arith": "SELECT l_extendedprice * (1 - l_discount) AS rev, -l_tax AS neg, l_linenumber + 1 AS nxt, l_quantity - 2 AS less FROM lineitem",
    "project_default_names": ("SELECT 1 + 2, n_regionkey, 5 + n_nationkey FROM nation", 'SELECT 3 AS "3", n_regionkey, 5 + n_nationkey AS "5 + n_nationkey" FROM nation'),
    "scalar_select": "SELECT 3 AS a, 1 + 2 AS b",
    "table_alias": "SELECT x.n_name FROM nation AS x WHERE x.n_regionkey = 1",
    # filters and predicates
    "filter_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3",
    "filter_eq_double_sign": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber == 3", "SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3"),
    "filter_ne": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3",
    "filter_lt": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10",
    "filter_le": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 10",
    "filter_gt": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40",
    "filter_ge": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 40",
    "filter_and_or_not": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE NOT (l_quantity > 10 AND l_discount < 0.05) OR l_linenumber = 2 AND l_tax > 0.02", "SELECT l_orderkey, l_quantity FROM lineitem WHERE NOT (l_quantity > 10 AND l_discount < 0.05::DOUBLE) OR l_linenumber = 2 AND l_tax > 0.02::DOUBLE"),
    "filter_is_null": "SELECT c.c_custkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000 WHERE o.o_orderkey IS NULL",
    "filter_is_not_null": "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 490000 WHERE o.o_orderkey IS NOT NULL",
    "filter_string_eq": "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND NOT l_linestatus = 'O'",
    "filter_column_compare": "SELECT l_orderkey FROM lineitem WHERE l_orderkey > l_partkey",
    # arithmetic
    "arith_int_div": ("SELECT l_partkey / 7 AS q, -l_partkey / 4 AS m FROM lineitem", "SELECT l_partkey // 7 AS q, (-l_partkey) // 4 AS m FROM lineitem"),
    "arith_float_div": "SELECT l_extendedprice / l_quantity AS unit FROM lineitem",
    "arith_float_div_zero": ("SELECT l_quantity / (l_discount * 0) AS x FROM lineitem WHERE l_linenumber = 1", "SELECT l_quantity / (l_discount * 0) AS x FROM lineitem WHERE l_linenumber = 1"),
    "arith_mod": "SELECT l_orderkey % 5 AS r, -l_orderkey % 4 AS s FROM lineitem",
    "arith_precedence": "SELECT 2 + l_linenumber * 3 - (l_linenumber - 1) * 2 AS v FROM lineitem",
    # scalar functions
    "fn_abs": "SELECT ABS(s_acctbal) AS v FROM supplier",
    "fn_ceil": "SELECT CEIL(s_acctbal) AS v FROM supplier",
    "fn_floor": "SELECT FLOOR(s_acctbal) AS v FROM supplier",
    "fn_exp": "SELECT l_orderkey, EXP(l_discount) AS v FROM lineitem",
    "fn_ln": "SELECT l_orderkey, LN(l_quantity) AS v FROM lineitem",
    "fn_sqrt": "SELECT l_orderkey, SQRT(l_quantity) AS v FROM lineitem",
    "fn_power": "SELECT l_orderkey, POWER(l_quantity, 2) AS v FROM lineitem",
    "fn_sin": "SELECT l_orderkey, SIN(l_quantity) AS v FROM lineitem",
    "fn_cos": "SELECT l_orderkey, COS(l_quantity) AS v FROM lineitem",
    "fn_tan": "SELECT l_orderkey, TAN(l_discount) AS v FROM lineitem",
    "fn_asin": "SELECT l_orderkey, ASIN(l_discount) AS v FROM lineitem",
    "fn_acos": "SELECT l_orderkey, ACOS(l_discount) AS v FROM lineitem",
    "fn_atan": "SELECT l_orderkey, ATAN(l_quantity) AS v FROM lineitem",
    "fn_atan2": "SELECT l_orderkey, ATAN2(l_quantity, l_tax) AS v FROM lineitem",
    "fn_coalesce": ("SELECT c.c_custkey, COALESCE(o.o_totalprice, 0.0) AS v FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c.c_custkey, COALESCE(o.o_totalprice, 0.0::DOUBLE) AS v FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000"),
    "fn_coalesce_filter": ("SELECT c_custkey FROM customer WHERE COALESCE(c_acctbal, 0.0) > 5000", "SELECT c_custkey FROM customer WHERE COALESCE(c_acctbal, 0.0::DOUBLE) > 5000"),
    "fn_mod": "SELECT l_orderkey, MOD(l_orderkey, 7) AS v FROM lineitem",
    "fn_sgn": ("SELECT s_suppkey, SGN(s_acctbal) AS v FROM supplier", "SELECT s_suppkey, SIGN(s_acctbal)::DOUBLE AS v FROM supplier"),
    # further predicates
    "filter_like": "SELECT n_name FROM nation WHERE n_name LIKE '%1_' AND n_name NOT LIKE '%_12'",
    "filter_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_returnflag NOT IN ('A', 'N')",
    "filter_in_subquery": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber NOT BETWEEN 2 AND 5",
    "filter_exists": "SELECT n_name FROM nation WHERE EXISTS (SELECT r_name FROM region WHERE r_regionkey = 1) AND NOT EXISTS (SELECT r_name FROM region WHERE r_regionkey > 100)",
    "expr_case": "SELECT l_orderkey, CASE WHEN l_quantity > 30 THEN 'many' WHEN l_quantity > 10 THEN 'some' ELSE 'few' END AS v, CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 20 END AS w FROM lineitem",
    "expr_cast": ("SELECT l_orderkey, CAST(l_orderkey AS VARCHAR(20)) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST('12' AS INTEGER) AS c FROM lineitem", "SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST('12' AS INTEGER) AS c FROM lineitem"),
    "string_quote": "SELECT n_name, 'it''s' AS v FROM nation",
    # DISTINCT
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_all": "SELECT ALL n_regionkey FROM nation",
    # aggregates
    "count_star": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000",
    "count_col": "SELECT COUNT(o.o_orderkey) AS n, COUNT(*) AS m FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem",
    "sum_int": ("SELECT SUM(l_linenumber) AS s FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "sum_double": ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag"),
    "sum_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS s FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "avg": ("SELECT AVG(l_linenumber) AS a, AVERAGE(l_linenumber) AS b, MEAN(l_linenumber) AS c FROM lineitem", "SELECT AVG(l_linenumber) AS a, AVG(l_linenumber) AS b, AVG(l_linenumber) AS c FROM lineitem"),
    "avg_distinct": "SELECT AVG(DISTINCT l_linenumber) AS a FROM lineitem",
    "min_max": "SELECT MIN(l_shipdate) AS a, MAX(l_shipdate) AS b, MIN(l_quantity) AS c, MAX(l_returnflag) AS d FROM lineitem",
    "stddev_samp": ("SELECT l_returnflag, STDDEV(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, STDDEV_SAMP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"),
    "var_samp": ("SELECT l_returnflag, VARIANCE(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, VAR_SAMP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"),
    "stddev_pop": ("SELECT l_returnflag, STDDEVP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, STDDEV_POP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"),
    "var_pop": ("SELECT l_returnflag, VARIANCEP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, VAR_POP(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"),
    "stats_distinct_more": ("SELECT AVERAGE(DISTINCT l_linenumber) AS a, MEAN(DISTINCT l_linenumber + 1) AS b, STDDEV(DISTINCT l_linenumber) AS c, STDDEVP(DISTINCT l_linenumber + 1) AS d FROM lineitem", "SELECT AVG(DISTINCT l_linenumber) AS a, AVG(DISTINCT l_linenumber + 1) AS b, STDDEV_SAMP(DISTINCT l_linenumber) AS c, STDDEV_POP(DISTINCT l_linenumber + 1) AS d FROM lineitem"),
    "stats_distinct": ("SELECT MIN(DISTINCT l_linenumber) AS a, MAX(DISTINCT l_linenumber) AS b, VARIANCE(DISTINCT l_linenumber) AS c FROM lineitem", "SELECT MIN(l_linenumber) AS a, MAX(l_linenumber) AS b, VAR_SAMP(DISTINCT l_linenumber) AS c FROM lineitem"),
    "group_by_one": "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
    "group_by_two": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_no_agg": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_null_key": "SELECT o.o_orderstatus, COUNT(*) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY o.o_orderstatus",
    "multi_agg": ("SELECT l_linestatus, COUNT(*) AS a, SUM(l_linenumber) AS b, MIN(l_tax) AS c, MAX(l_tax) AS d, COUNT(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, COUNT(*) AS a, CAST(SUM(l_linenumber) AS BIGINT) AS b, MIN(l_tax) AS c, MAX(l_tax) AS d, COUNT(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY l_linestatus"),
    "agg_arith": ("SELECT l_suppkey, SUM(l_linenumber) / COUNT(*) AS q, SUM(l_linenumber) + 1 AS s FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, CAST(SUM(l_linenumber) AS BIGINT) // COUNT(*) AS q, CAST(SUM(l_linenumber) + 1 AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey"),
    "agg_of_expression": "SELECT l_suppkey, MAX(l_quantity * (1 - l_discount)) AS m, COUNT(l_quantity + l_tax) AS n FROM lineitem GROUP BY l_suppkey",
    "global_agg_empty": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, AVG(l_tax) AS a FROM lineitem WHERE FALSE", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_tax) AS a FROM lineitem WHERE FALSE"),
    "having": "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 500 AND MIN(l_quantity) < 5",
    "having_global": "SELECT COUNT(*) AS n FROM lineitem HAVING COUNT(*) > 1000000000",
    # joins
    "join_inner_on": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey",
    "join_theta": "SELECT COUNT(*) AS n FROM supplier AS s JOIN customer AS c ON s.s_acctbal > c.c_acctbal",
    "join_inner_multi": "SELECT r.r_name, COUNT(*) AS n FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey JOIN customer AS c ON c.c_nationkey = n.n_nationkey JOIN orders AS o ON o.o_custkey = c.c_custkey GROUP BY r.r_name",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_no_condition": ("SELECT n_name, r_name FROM nation JOIN region", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders AS o RIGHT OUTER JOIN customer AS c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_full": "SELECT c.c_custkey, o.o_orderkey FROM customer AS c FULL OUTER JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 AND c.c_acctbal > 0",
    "join_left_theta": "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s LEFT JOIN nation AS n ON s.s_nationkey < n.n_nationkey AND n.n_nationkey > 20",
    "join_full_theta": "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s FULL JOIN nation AS n ON s.s_nationkey < n.n_nationkey AND n.n_nationkey > 20",
    "join_using": ("SELECT doc_id, source, toxic FROM documents JOIN labels USING doc_id", "SELECT doc_id, source, toxic FROM documents JOIN labels USING (doc_id)"),
    "join_using_left": "SELECT doc_id, source, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "join_natural": "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels",
    "join_natural_left": "SELECT doc_id, lang, quality FROM documents NATURAL LEFT JOIN labels",
    "join_natural_right": "SELECT doc_id, lang, quality FROM labels NATURAL RIGHT JOIN documents",
    "join_natural_full": "SELECT doc_id, lang, quality FROM documents NATURAL FULL JOIN labels",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_nested_right": "SELECT r.r_name, n.n_name, s.s_suppkey FROM region AS r JOIN (nation AS n JOIN supplier AS s ON n.n_nationkey = s.s_nationkey) ON r.r_regionkey = n.n_regionkey",
    "join_semi": ("SELECT c_custkey FROM customer AS c LEFT SEMI JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 300000)"),
    "join_anti": ("SELECT c_custkey FROM customer AS c LEFT ANTI JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 300000)"),
    "join_where": "SELECT o.o_orderkey, l.l_quantity FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45 AND o.o_orderstatus = 'F'",
    # order and limits
    "order_by": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "limit_n": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    # subqueries
    "subquery_scalar": "SELECT n_name, (SELECT COUNT(*) FROM region) AS regions FROM nation",
    "subquery_in_where": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > (SELECT AVG(l_quantity) FROM lineitem)",
    "subquery_max": "SELECT (SELECT MAX(o_totalprice) FROM orders) - o_totalprice AS gap FROM orders",
    "flagship": (FLAGSHIP, FLAGSHIP.replace("0.05", "0.05::DOUBLE").replace("STDDEV(", "STDDEV_SAMP(")),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, directory=sf_dir, names=TABLES)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    return values(spark, T.StructType.fromDDL("foo int, bar int"), [(3, 4), (4, 5)])


def _insert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return s.sql("""
        CREATE TEMPORARY TABLE foo (a INTEGER, b FLOAT, c VARCHAR(20));
        INSERT INTO foo VALUES (1, 2, 'x'), (2, 3.5, NULL);
        INSERT INTO foo (c, a) VALUES ('y', 1 + 2);
        SELECT * FROM foo
    """)


def _insert_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, directory=sf_dir, names=TABLES, database="tidewater_insert")
    if "foo" in s.catalog.managed():
        s.execute("DROP TABLE foo")
    s.script("CREATE TABLE foo (a INTEGER, b DOUBLE, c VARCHAR(20)); INSERT INTO foo VALUES (1, 2, 'x'), (2, 3.5, NULL); INSERT INTO foo (c, a) VALUES ('y', 1 + 2)")
    return s.sql("SELECT * FROM foo")


def _insert_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is inserted is what the query gave at that time."""
    return session(spark, sf_dir).sql("""
        CREATE TEMPORARY TABLE m (a INTEGER);
        CREATE TEMPORARY TABLE c (n BIGINT, r BIGINT);
        INSERT INTO m VALUES (1), (2);
        INSERT INTO c VALUES ((SELECT COUNT(*) FROM m), (SELECT COUNT(*) FROM region));
        INSERT INTO m VALUES (3);
        SELECT n, r FROM c
    """)


def _coalesce_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("""
        CREATE TEMPORARY TABLE t (a DECIMAL(9, 4), b DECIMAL(18, 2), c BIGINT);
        INSERT INTO t VALUES (2, NULL, 7), (NULL, 1234567890123456, 8), (NULL, NULL, 9007199254740993);
        SELECT CAST(COALESCE(a, b) AS DOUBLE) AS x, CAST(COALESCE(a * a, 0) AS DOUBLE) AS y, CAST(COALESCE(a, c) AS BIGINT) AS z FROM t
    """)


def _create_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000; SELECT COUNT(*) AS n, MAX(c_acctbal) AS m FROM rich")


def _create_drop_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, database="tidewater_catalogue")
    for name in s.catalog.managed():
        s.execute(f'DROP TABLE "{name}"')
    s.script("CREATE TABLE buz (a INTEGER); CREATE TABLE IF NOT EXISTS buz (a INTEGER); CREATE TABLE bar (a BIGINT, b DECIMAL(9, 4)); CREATE TABLE foo (a CHAR(5)); DROP TABLE bar")
    return s.sql("SHOW TABLES")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: _query(text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
    return own | {"values_rows": _values, "insert_roundtrip": _insert_roundtrip, "insert_managed": _insert_managed, "insert_subquery": _insert_subquery, "coalesce_decimal": _coalesce_decimal, "create_view": _create_view, "create_drop_show": _create_drop_show}


def oracle_sql() -> dict[str, str]:
    own = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}
    return own | {
        "values_rows": "SELECT * FROM (VALUES (3, 4), (4, 5)) AS v(foo, bar)",
        "insert_roundtrip": "SELECT * FROM (VALUES (1::INTEGER, 2::FLOAT, 'x'), (2, 3.5::FLOAT, NULL), (3, NULL, 'y')) AS v(a, b, c)",
        "insert_managed": "SELECT * FROM (VALUES (1::INTEGER, 2::DOUBLE, 'x'), (2, 3.5::DOUBLE, NULL), (3, NULL, 'y')) AS v(a, b, c)",
        "insert_subquery": "SELECT 2::BIGINT AS n, (SELECT COUNT(*) FROM region) AS r",
        "coalesce_decimal": "SELECT * FROM (VALUES (2::DOUBLE, 4::DOUBLE, 2::BIGINT), (1234567890123456::DOUBLE, 0::DOUBLE, 8), (NULL, 0::DOUBLE, 9007199254740993)) AS v(x, y, z)",
        "create_view": "SELECT COUNT(*) AS n, MAX(c_acctbal) AS m FROM customer WHERE c_acctbal > 5000",
        "create_drop_show": """SELECT * FROM (VALUES ('buz'), ('foo')) AS v("TABLE NAME")""",
    }
