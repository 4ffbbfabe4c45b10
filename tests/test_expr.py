import math

import pytest

from tallyspark.functions.expr import check_name, compile_expression, compile_predicate
from tallyspark.types import DType, Field, Schema

S = Schema("t", (Field("a", DType.INT64), Field("b", DType.FLOAT64), Field("s", DType.STRING), Field("k", DType.BOOL), Field("t", DType.TIMESTAMP_NS)))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, 7, 2.5, "x", True), (2, -7, 0.0, "y", False), (3, 0, -4.0, None, None), (4, None, float("nan"), "z", True)], "n int, a long, b double, s string, k boolean")


def values(frame, text):
    return [r[0] for r in frame.orderBy("n").select(compile_expression(text, S).value.alias("x")).collect()]


@pytest.mark.parametrize("text, kind", [("a + 1", DType.INT64), ("a + 1.0", DType.FLOAT64), ("a / 2", DType.INT64), ("b / a", DType.FLOAT64), ("a % 3", DType.INT64), ("-b", DType.FLOAT64), ("not k", DType.BOOL), ("a < b", DType.BOOL), ("0 < a < 9", DType.BOOL), ("k and a > 1", DType.BOOL), ("sqrt(a)", DType.FLOAT64), ("abs(a)", DType.INT64), ("min(a, 3)", DType.INT64), ("max(a, b)", DType.FLOAT64), ("'x'", DType.STRING), ("True", DType.BOOL), ("t == t", DType.BOOL)])
def test_types_are_inferred_and_match_spark(spark, text, kind):
    made = compile_expression(text, S)
    assert made.dtype is kind
    empty = spark.createDataFrame([], S.spark)
    assert DType.of(empty.select(made.value.alias("x")).schema["x"].dataType) is kind


@pytest.mark.parametrize("text", ["", "  ", "a +", "a.b", "a[0]", "lambda: 1", "[x for x in a]", "a if k else b", "a ** 2", "a // 2", "foo(a)", "sqrt(x=a)", "sqrt(*a)", "__import__('os')", "__class__", "None", "b'x'", "1j", "a is b", "a in b", "a & b", "~a", "a := 1", "f'{a}'", "nope", "(a, b)", "{1}", "min(a)", "sqrt(a, b)", "abs()", "s.upper()", "99999999999999999999", "isNull(a)", "a; b"])
def test_anything_off_the_list_is_refused(text):
    with pytest.raises(ValueError):
        compile_expression(text, S)


@pytest.mark.parametrize("text", ["s + s", "s + 1", "a + k", "-s", "-k", "not a", "a and b", "k or 1", "s > a", "k == 1", "t < 5", "s == t", "sqrt(s)", "abs(k)", "min(a, s)", "log(t)"])
def test_wrong_types_are_refused(text):
    with pytest.raises(ValueError):
        compile_expression(text, S)


def test_ieee_results(frame):
    assert values(frame, "b / 0.0")[:3] == [math.inf, pytest.approx(math.nan, nan_ok=True), -math.inf]
    assert values(frame, "a / 2") == [3, -3, 0, None]
    assert values(frame, "a % 3") == [1, -1, 0, None]
    got = values(frame, "log(b)")
    assert got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3])
    assert math.isnan(values(frame, "sqrt(b)")[2])
    low = values(frame, "min(a, b)")
    assert low[:3] == [2.5, -7.0, -4.0] and low[3] is None
    assert math.isnan(values(frame, "max(b, 1.0)")[3])


def test_not_of_a_chain_negates_all_of_it(frame):
    assert values(frame, "not (0 < a < 5)") == [True, True, True, None]


def test_predicates_take_the_older_notation(frame):
    def kept(text):
        return [r[0] for r in frame.where(compile_predicate(text, S)).orderBy("n").select("n").collect()]

    assert kept("a > 0 && s = `x`") == [1]
    assert kept("!(a > 0) || s == 'z'") == [2, 3, 4]
    assert kept("isNull(a)") == [4]
    assert kept("!isNull(s) && k = true") == [1, 4]
    assert kept("s != 'a=b&&c'") == [1, 2, 4]
    for bad in ("a + 1", "s > a", "a >", "nope = 1"):
        with pytest.raises(ValueError, match="predicate"):
            compile_predicate(bad, S)


@pytest.mark.parametrize("name", ["", "1a", "a b", "a-b", "__a", "a.b", None])
def test_names(name):
    with pytest.raises(ValueError):
        check_name(name)
    assert check_name("Ok_1") == "Ok_1"
