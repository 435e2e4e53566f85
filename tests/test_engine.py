"""Golden results, divergences from the usual and errors."""

import math
from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater import Session, errors
from tidewater.operators import grouped, limit_offset, natural_join, one_row, using_join
from tidewater.sources.printing import show, text_table


@pytest.fixture
def session(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Session(
        spark,
        {
            "e2": frame([(3, 1), (4, 1), (5, 1), (7, 2), (12, 2), (32, 2)], "a int, b int"),
            "e5": frame([(3, 1, 1), (3, 1, 2), (5, 1, 3), (5, 2, 4), (7, 2, 5), (12, 2, 6)], "a int, b int, c int"),
            "e8": frame([(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (4, 2), (1, 2), (2, 2)], "a int, b int"),
            "e9": frame([(3, 6, "bar"), (3, 7, "baz"), (2, 10, "baz"), (1, 9, "foo"), (1, 13, "foo"), (None, None, None)], "a int, b int, c string"),
            "e10": frame([(3, 6, 1), (3, 6, 2), (2, 10, 3), (1, 9, 4), (1, 6, 5), (None, 6, 5)], "a int, b int, c int"),
            "l": frame([(1, 2), (3, 4)], "a int, b int"),
            "r": frame([(3, 6), (7, 8)], "a int, c int"),
            "none": frame([], "a int, c int"),
            "small": frame([(1,)], "a int"),
            "nan": frame([(float("nan"), 1), (float("nan"), 2), (1.0, 3)], "k double, v int"),
            "dup": frame([(7, 1), (7, 1), (9, 2)], "a int, c int"),
        },
        database="tidewater_tests",
    )


def rows(session, sql):
    return sorted((tuple(r) for r in session.sql(sql).collect()), key=repr)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT SUM(a) FROM e2", [(63,)]),
        ("SELECT SUM(a) FROM e2 GROUP BY b", [(12,), (51,)]),
        ("SELECT AVERAGE(a), AVG(a) AS x, MEAN(a) AS y FROM e2", [(10.5, 10.5, 10.5)]),
        ("SELECT AVERAGE(a) FROM e2 GROUP BY b", [(17.0,), (4.0,)]),
        ("SELECT SUM(DISTINCT a), AVERAGE(DISTINCT a) FROM e5", [(27, 6.75)]),
        ("SELECT SUM(DISTINCT a), b FROM e5 GROUP BY b", [(24, 2), (8, 1)]),
        ("SELECT MIN(a), MAX(a), b FROM e2 GROUP BY b", [(3, 5, 1), (7, 32, 2)]),
        ("SELECT VARIANCE(a), STDDEVP(a) FROM small", [(None, 0.0)]),
        ("SELECT COUNT(b), COUNT(*) FROM e9", [(5, 6)]),
        ("SELECT a, COUNT(b) FROM e9 GROUP BY a", [(1, 2), (2, 1), (3, 2), (None, 0)]),
        ("SELECT COUNT(DISTINCT a) FROM e10", [(3,)]),
        ("SELECT COUNT(DISTINCT a), b FROM e10 GROUP BY b", [(1, 10), (1, 9), (2, 6)]),
        ("SELECT k, COUNT(*) FROM nan GROUP BY k", [(1.0, 1), (math.nan, 2)]),
        # joins
        ("SELECT l.a AS x, b, r.a AS y, c FROM l JOIN r ON l.a = r.a", [(3, 4, 3, 6)]),
        ("SELECT l.a AS x, c FROM l LEFT JOIN r ON l.a = r.a", [(1, None), (3, 6)]),
        ("SELECT l.a AS x, r.a AS y FROM l RIGHT JOIN r ON l.a = r.a", [(3, 3), (None, 7)]),
        ("SELECT l.a AS x, r.a AS y FROM l FULL JOIN r ON l.a = r.a", [(1, None), (3, 3), (None, 7)]),
        ("SELECT l.a AS x, d.a AS y FROM l FULL JOIN dup AS d ON l.a = d.a", [(1, None), (3, None), (None, 7), (None, 7), (None, 9)]),
        ("SELECT l.a AS x FROM l CROSS JOIN none", []),
        ("SELECT l.a AS x, c FROM l LEFT JOIN none ON l.a = none.a", [(1, None), (3, None)]),
        ("SELECT * FROM l NATURAL JOIN r", [(3, 4, 6)]),
        ("SELECT * FROM l NATURAL FULL JOIN r", [(1, 2, None), (3, 4, 6), (7, None, 8)]),
        ("SELECT * FROM l NATURAL RIGHT JOIN r", [(3, 4, 6), (7, None, 8)]),
        ("SELECT a, l.a AS x, r.a AS y FROM l LEFT JOIN r USING a", [(1, 1, None), (3, 3, 3)]),
        ("SELECT l.a FROM l LEFT ANTI JOIN r ON l.a = r.a", [(1,)]),
        ("SELECT l.a FROM l LEFT SEMI JOIN r USING (a)", [(3,)]),
        ("SELECT x.a AS p, y.a AS q FROM l AS x JOIN l AS y ON x.a < y.a", [(1, 3)]),
        ("SELECT l.a AS x FROM l JOIN (r JOIN dup AS d ON r.a = d.a) ON l.a < r.a", [(1,), (1,), (3,), (3,)]),
        # filters apply after joins and on aliases; NULL is unknown
        ("SELECT l.a AS x FROM l JOIN r ON TRUE WHERE c > 6", [(1,), (3,)]),
        ("SELECT x.a FROM e9 AS x WHERE x.b > 9", [(1,), (2,)]),
        ("SELECT a FROM e9 WHERE NOT a = 3", [(1,), (1,), (2,)]),
        ("SELECT a FROM e9 WHERE a = NULL", []),
        ("SELECT a FROM e9 WHERE c = 'bar'", [(3,)]),
        # arithmetic
        ("SELECT 123 + 432 AS a, 123 - 432 AS b, 3 * 7 AS c, 11 / 4 AS d, 11 % 4 AS e, -11 / 4 AS f, -11 % 4 AS g", [(555, -309, 21, 2, 3, -2, -3)]),
        ("SELECT 11 / 4f AS a, 11 / 4.0 AS b", [(2.75, 2.75)]),
        ("SELECT 1.0 / 0 AS a, -1.0 / 0 AS b", [(math.inf, -math.inf)]),
        ("SELECT LN(0) AS a, LN(1) AS b", [(-math.inf, 0.0)]),
        ("SELECT CEIL(1.2) AS a, FLOOR(-1.2) AS b, CEIL(3) AS c, ABS(-2) AS d, POWER(2, 3) AS e, ATAN2(0, 1) AS f", [(2.0, -2.0, 3, 2, 8.0, 0.0)]),
        ("SELECT COALESCE(NULL, 47) AS a, COALESCE(NULL, 'x') AS b, COALESCE(1, 2.5) AS c", [(47, "x", 1.0)]),
        # DISTINCT, HAVING, LIMIT, OFFSET take effect
        ("SELECT DISTINCT b FROM e2", [(1,), (2,)]),
        ("SELECT b FROM e2 GROUP BY b HAVING SUM(a) > 20", [(2,)]),
        ("SELECT a FROM e2 ORDER BY a LIMIT 2 OFFSET 1", [(4,), (5,)]),
        ("SELECT a FROM e2 LIMIT 0", []),
        ("SELECT SUM(a) / COUNT(*) AS q FROM e2", [(10,)]),
        ("SELECT COUNT(*), SUM(a) FROM none", [(0, None)]),
        # subqueries
        ("SELECT a FROM e2 WHERE a > (SELECT AVG(a) FROM e2)", [(12,), (32,)]),
        ("SELECT (SELECT MAX(a) FROM e2) - a AS gap FROM l", [(29,), (31,)]),
        ("SELECT (SELECT a FROM none) AS x", [(None,)]),
    ],
)
def test_results(session, sql, want):
    assert [repr(r) for r in rows(session, sql)] == sorted(map(repr, want))


def test_moments(session):
    got = session.sql("SELECT VARIANCE(a), STDDEV(a), VARIANCEP(a), STDDEVP(a) FROM e8").first()
    assert list(got) == pytest.approx([167 / 56, math.sqrt(167 / 56), 167 / 64, math.sqrt(167 / 64)])
    got = session.sql("SELECT b, VARIANCE(a), VARIANCEP(a) FROM e8 GROUP BY b ORDER BY b").collect()
    assert [v for r in got for v in r] == pytest.approx([1, 5 / 3, 5 / 4, 2, 59 / 12, 59 / 16])


def test_names_and_types(session):
    df = session.sql("SELECT SUM(a), 1 + 2, A, 5 + B FROM e2 GROUP BY a, b")
    assert df.columns == ["SUM(a)", "3", "a", "5 + B"]
    types = dict(session.sql("SELECT ABS(a) AS i, a + 1L AS l, a + .f AS f, a / 2.0 AS d, a = 1 AS b, 1 / 2 AS q FROM e2").dtypes)
    assert types == {"i": "int", "l": "bigint", "f": "float", "d": "double", "b": "boolean", "q": "int"}


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT * FROM bar", errors.UnknownTable),
        ("SELECT z FROM l", errors.UnknownColumn),
        ("SELECT l.z FROM l", errors.UnknownColumn),
        ("SELECT q.* FROM l", errors.UnknownColumn),
        ("SELECT a FROM l JOIN r ON TRUE", errors.AmbiguousColumn),
        ("SELECT l.a, r.a FROM l JOIN r ON TRUE", errors.DuplicateName),
        ("SELECT * FROM l JOIN l ON TRUE", errors.DuplicateName),
        ("SELECT * FROM l NATURAL JOIN (e2 AS x JOIN e5 AS y ON TRUE)", errors.JoinColumnError),
        ("SELECT * FROM small AS s NATURAL JOIN nan", errors.JoinColumnError),
        ("SELECT * FROM l JOIN r USING a, a", errors.JoinColumnError),
        ("SELECT * FROM l JOIN r USING b", errors.JoinColumnError),
        ("SELECT a FROM l WHERE SUM(a) > 1", errors.AggregateError),
        ("SELECT COUNT(COUNT(a)) FROM l", errors.AggregateError),
        ("SELECT a FROM l GROUP BY a + 1", errors.AggregateError),
        ("SELECT b FROM l GROUP BY a", errors.UnknownColumn),
        ("SELECT a FROM l HAVING a > 1", errors.AggregateError),
        ("SELECT SUM(*) FROM l", errors.TypeMismatch),
        ("SELECT COUNT(a, b) FROM l", errors.ArityError),
        ("SELECT SIN(DISTINCT a) FROM l", errors.AggregateError),
        ("SELECT BAR(a) FROM l", errors.UnknownFunction),
        ("SELECT POWER(a) FROM l", errors.ArityError),
        ("SELECT SIN() FROM l", errors.ArityError),
        ("SELECT COALESCE() FROM l", errors.ArityError),
        ("SELECT 763L + TRUE", errors.TypeMismatch),
        ("SELECT c + 1 FROM e9", errors.TypeMismatch),
        ("SELECT a FROM e9 WHERE c = 1", errors.TypeMismatch),
        ("SELECT a FROM l WHERE a", errors.TypeMismatch),
        ("SELECT a FROM l WHERE a AND TRUE", errors.TypeMismatch),
        ("SELECT SUM(c) FROM e9", errors.TypeMismatch),
        ("SELECT *", errors.BindError),
        ("SELECT (SELECT a, b FROM l) AS x", errors.BindError),
        ("SELECT DISTINCT a FROM l ORDER BY b", errors.BindError),
        ("SHOW VARIABLES", errors.NotSupported),
        ("DROP TABLE bar", errors.UnknownTable),
        ("CREATE TABLE t (a TIME)", errors.NotSupported),
        ("CREATE TABLE t (a INT, A INT)", errors.DuplicateName),
        ("INSERT INTO l VALUES (1, 2)", errors.NotSupported),
    ],
)
def test_errors(session, sql, error):
    with pytest.raises(error):
        session.execute(sql)


def test_subquery_of_many_rows_fails(session):
    with pytest.raises((PySparkException, Py4JJavaError), match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        session.sql("SELECT (SELECT a FROM e2) AS x").collect()


def test_integer_division_by_zero_fails(session):
    with pytest.raises(PySparkException):
        session.sql("SELECT a / 0 AS x FROM e2").collect()


def test_tables(session):
    for name in session.catalog.managed():
        session.execute(f'DROP TABLE "{name}"')
    session.script("CREATE TABLE foo (a INTEGER, b FLOAT, c VARCHAR(4), d DATE); INSERT INTO foo VALUES (1, 2, 'x', '2024-01-31'); INSERT INTO FOO (c, a) VALUES ('y', 1 + 2), (NULL, 4)")
    assert rows(session, "SELECT * FROM foo") == sorted([(1, 2.0, "x", date(2024, 1, 31)), (3, None, "y", None), (4, None, None, None)], key=repr)
    assert ("foo",) in rows(session, "SHOW TABLES")
    session.execute("CREATE TABLE IF NOT EXISTS foo (z INT)")
    with pytest.raises(errors.TableExists):
        session.execute("CREATE TABLE Foo (z INT)")
    with pytest.raises(errors.TypeMismatch):
        session.execute("INSERT INTO foo (a) VALUES ('x')")
    with pytest.raises(errors.ArityError):
        session.execute("INSERT INTO foo VALUES (1)")
    with pytest.raises(errors.UnknownColumn):
        session.execute("INSERT INTO foo (q) VALUES (1)")
    with pytest.raises(PySparkException):
        session.execute("INSERT INTO foo (c) VALUES ('longer')")
    session.execute("DROP TABLE foo")
    with pytest.raises(errors.UnknownTable):
        session.execute("SELECT * FROM foo")


def test_temporary_tables_and_views(session):
    session.script("CREATE TEMPORARY TABLE t (a INTEGER, c CHAR(3)); INSERT INTO t VALUES (1, 'ab'); CREATE VIEW v AS SELECT a + 1 AS b FROM t")
    assert rows(session, "SELECT c, b FROM t JOIN v ON TRUE") == [("ab", 2)]
    assert "t" not in session.catalog.managed()
    with pytest.raises(PySparkException):
        session.execute("INSERT INTO t VALUES (1, 'abcd')")
    assert rows(session, "SELECT * FROM t") == [(1, "ab")]  # a bad row leaves the table as it was
    session.execute("INSERT INTO t VALUES " + ", ".join(f"({k}, 'x')" for k in range(300)))
    assert rows(session, "SELECT COUNT(*) AS n FROM t") == [(301,)]
    session.execute("DROP TABLE t")
    with pytest.raises(errors.UnknownTable):
        session.execute("SELECT * FROM t")


def test_plan_prunes_and_pushes(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("twice"), F.lit("x").alias("pad")).write.parquet(str(tmp_path / "t.parquet"))
    plan = Session(spark, directory=str(tmp_path), names=("t",)).explain("SELECT id FROM t WHERE twice > 20")
    assert "pad" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThan(twice,20)" in plan


def test_printing(session):
    assert text_table(["FOO", "BAR BAR"], [["a", None], ["bcde", True]]).splitlines() == ["+------+---------+", "|  FOO | BAR BAR |", "+------+---------+", "|    a |    NULL |", "| bcde |    TRUE |", "+------+---------+"]
    assert "63" in show(session.sql("SELECT SUM(a) FROM e2"))


def test_show_says_what_it_leaves_out(session):
    out = show(session.sql("SELECT a FROM e2"), rows=1)
    n = len(rows(session, "SELECT a FROM e2"))
    assert out.splitlines()[-1] == f"{n - 1} more rows"


def test_explain_and_quotes(session):
    plan = [r[0] for r in session.sql("EXPLAIN SELECT a FROM e2 WHERE a > 1").collect()]
    assert any("Physical Plan" in line for line in plan)
    assert rows(session, "SELECT 'it''s' AS x, 1.0 / -0.0 AS y, 1.0 / 0.0 AS z") == [("it's", float("-inf"), float("inf"))]


def test_shell(session):
    from tidewater.__main__ import repl

    lines, out = iter(["SELECT 1 + 1", "AS two;", "SELECT nope;", "quit"]), []
    repl(session, lambda _: next(lines), out.append)
    assert "two" in out[0] and "UnknownColumn" in out[1]


def test_dataframe_operators(spark):
    l, r = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(3, 6), (7, 8)], "a int, c int")
    assert sorted(map(tuple, natural_join(l, r, "full").collect()), key=repr) == [(1, 2, None), (3, 4, 6), (7, None, 8)]
    with pytest.raises(errors.JoinColumnError):
        using_join(l, r, ["b"])
    with pytest.raises(errors.JoinColumnError):
        natural_join(l.select("b"), r)
    assert limit_offset(l, "a", limit=1, offset=1).first().a == 3
    assert one_row(spark, F.lit(5).alias("x")).collect()[0].x == 5
    got = grouped(l.union(l), ["a"], n=("count", None), s=("sum", "b", True)).orderBy("a").collect()
    assert [tuple(x) for x in got] == [(1, 2, 2), (3, 2, 4)]
    assert grouped(l.union(l), ["a"]).count() == 2
