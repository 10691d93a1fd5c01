"""The expression language: values, precedence, typing and errors."""

import math

import pytest

from marlstone.functions import expr

ROWS = [("1", "abc", 2.0, 5), ("1.0", "", -3.5, 0), ("abc", "x|y", 0.0, 7), (None, "abd", float("nan"), 1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "a string, b string, c double, d int")


def values(df, source, **more):
    return [r[0] for r in df.select(expr.expression(df, source, **more)).collect()]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("d + 1", [6, 1, 8, 2]), ("-d * 2 - -1", [-9, 1, -13, -1]), ("(d)-1", [4, -1, 6, 0]), ("2 + 3 * 4", [14] * 4), ("(2 + 3) * 4", [20] * 4), ("7 - 2 - 1", [4] * 4),
        ("d == 5 OR d == 7 AND c == 0", [0, 0, 1, 0]), ("d == 5 OR (d == 7 AND c == 0)", [1, 0, 1, 0]), ("NOT d == 5", [0, 1, 1, 1]), ("NOT NOT d == 5", [1, 0, 0, 0]),
        ("a == 1", [1, 1, None, None]), ("a == '1'", [1, 0, 0, 0]), ("a == 'abc'", [0, 0, 1, 0]), ("a < b", [1, 0, 1, 1]), ("b LIKE 'ab?'", [1, 0, 0, 1]), ("b ~= '*b*'", [1, 0, 0, 1]),
        ("b HAS 'x|'", [0, 0, 1, 0]), ("b IN 'abc|abd'", [1, 0, 0, 1]), ("b == ''", [0, 1, 0, 0]), ("TRUE && FALSE", [0] * 4), ("FALSE || TRUE", [1] * 4), ("b + '!'", ["abc!", "!", "x|y!", "abd!"]),
        ("@3 >= 5", [1, 0, 1, 0]), ("$d >= 5", [1, 0, 1, 0]), ("3 == 3", [1] * 4), ("1e2 + .5", [100.5] * 4), ("c LIKE 'a'", [0] * 4), ("d IN '5|7'", [1, 0, 1, 0]), ("d == '5'", [1, 0, 0, 0]), ("d HAS '5'", [1, 0, 0, 0]), ("b + d", ["abc5", "0", "x|y7", "abd1"]), ("1 LIKE 'a'", [None] * 4),
    ],
)
def test_values(df, source, expected):
    assert values(df, source) == expected


def test_division(df):
    assert values(df, "1 / d")[:2] == [0.2, math.inf] and values(df, "-1 / d")[1] == -math.inf and math.isnan(values(df, "d / 0 * 0")[0])


@pytest.mark.parametrize("source", ["a = 1", "(a == 1", "a == 1)", "a +", "", "nosuch > 1", "2 ^ 3", "@9 > 1", "a ==", "$9 == 1", "a b", "a ? b"])
def test_errors(df, source):
    with pytest.raises(expr.ExpressionError):
        expr.expression(df, source)


def test_strict(df):
    with pytest.raises(expr.ExpressionError):
        expr.expression(df, "'a' * 2", strict=True)
    with pytest.raises(Exception, match="incompatible types"):
        values(df, "a * 2", strict=True)
    assert values(df, "a * 2") == [2, 2, None, None]


def test_filters(spark, df):
    assert expr.rows_where(df, "a > 0").count() == 2
    assert expr.with_expression(df, "e", "d * d").columns[-1] == "e"
    wide = spark.createDataFrame([("r1", 1, 5), ("r2", 9, 2)], "k string, x int, y int")
    assert expr.columns_where(wide, "k", "r1 > 2").columns == ["k", "y"]


def test_plain_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as double) d", "id").write.parquet(str(tmp_path / "t"))
    plan = expr.rows_where(spark.read.parquet(str(tmp_path / "t")), "d == 3")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan
