import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.errors import SchemaMismatch
from tallyspark.operators import core
from tallyspark.types import CATALOG, DType, Field, Schema, schema_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_catalogue():
    assert len(CATALOG) == 19
    assert CATALOG["cash"].settled and CATALOG["nav"].settled and not CATALOG["quote"].settled
    with pytest.raises(ValueError):
        Schema("x", (Field("a", DType.BOOL), Field("a", DType.BOOL)))


def test_validate_tolerates_order_and_extras(spark):
    s = Schema("x", (Field("a", DType.INT64, False), Field("b", DType.STRING)))
    s.validate(spark.createDataFrame([("x", 1, 2.0)], "b string, a long, c double"))
    for bad in ("a long", "a string, b string"):
        with pytest.raises(SchemaMismatch):
            s.validate(spark.createDataFrame([], bad))
    assert schema_of(spark.createDataFrame([], "a int, b float, c date")).dtype("a") is DType.INT64


def test_last_keeps_nulls_and_first_is_first(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("a", 2, 5.0), (None, 1, 7.0)], "k string, _seq long, v double")
    assert rows(core.last_by(df, ["k"])) == [("a", 3, None), (None, 1, 7.0)]
    assert rows(core.first_by(df, ["k"])) == [("a", 1, 1.0), (None, 1, 7.0)]


def test_natural_join_never_multiplies_rows(spark):
    left = spark.createDataFrame([(1, "l"), (2, "l"), (None, "l")], "id long, x string")
    right = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "none", 3)], "key long, name string, _seq long")
    assert rows(core.natural_join(left, right, [("id", "key")], ["name"])) == [(1, "l", "new"), (2, "l", None), (None, "l", None)]


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 5, 3), (None, 5, 4), ("a", None, 5)], "k string, t long, n int")
    right = spark.createDataFrame([("a", 3, "old", 0), ("a", 5, "first", 1), ("a", 5, None, 2), (None, 1, "null key", 3), ("a", None, "null time", 4)], "k string, t long, v string, _seq long")
    assert rows(core.asof_join(left, right, ["k", "t"], ["v"])) == sorted([("a", 5, 1, None), ("a", 0, 2, None), ("b", 5, 3, None), (None, 5, 4, None), ("a", None, 5, None)], key=repr)
    assert rows(core.asof_join(left.where("n = 1"), right.where("_seq < 2"), ["k", "t"], ["v"])) == [("a", 5, 1, "first")]
    assert "BroadcastNestedLoop" not in core.asof_join(left, right, ["k", "t"], ["v"])._jdf.queryExecution().executedPlan().toString()


small = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(small, small)
def test_asof_against_a_loop(spark, left, right):
    ls = [(k, t, i) for i, (k, t) in enumerate(left)]
    rs = [(k, t, i) for i, (k, t) in enumerate(right)]
    want = []
    for k, t, i in ls:
        fit = [(b, s) for a, b, s in rs if a == k and b <= t]
        want.append((k, t, i, max(fit)[1] if fit else None))
    lf, rf = spark.createDataFrame(ls, "k string, t long, n int"), spark.createDataFrame([(*r, r[2]) for r in rs], "k string, t long, v int, _seq long")
    assert rows(core.asof_join(lf, rf, ["k", "t"], ["v"])) == sorted(want, key=repr)
    assert rows(core.asof_join(lf, rf, ["k", "t"], ["v"], bucket=2)) == sorted(want, key=repr)


def test_asof_of_one_hot_key_in_stretches(spark):
    left = spark.range(500).selectExpr("'hot' AS k", "timestamp_seconds(id * 37 % 1000) AS t", "id AS n").unionByName(spark.createDataFrame([(None, None, -1), ("hot", None, -2)], "k string, t timestamp, n long"))
    right = spark.range(60).selectExpr("'hot' AS k", "timestamp_seconds(id * 311 % 900 + 50) AS t", "CASE WHEN id % 5 > 0 THEN id END AS v", "id AS _seq")
    whole = core.asof_join(left, right, ["k", "t"], ["v"])
    parted = core.asof_join(left, right, ["k", "t"], ["v"], bucket=20)
    assert rows(parted) == rows(whole) and parted.where("v IS NOT NULL").count() > 300
    assert rows(core.asof_join(left, right, ["t"], ["v"], bucket=20)) == rows(core.asof_join(left, right, ["t"], ["v"]))


def test_pivot_is_driven_by_one_key(spark):
    df = spark.createDataFrame([("A", "x", 1.0, 1), ("A", "x", None, 3), ("A", "y", 2.0, 2), ("B", "y", 9.0, 4), ("C", "x", 4.0, 5)], "acct string, key string, v double, _seq long")
    assert rows(core.pivot_latest(df, ["acct"], "key", "v", {"x": "X", "y": "Y"}, "x")) == [("A", None, 2.0), ("C", 4.0, None)]


def test_files_without_numbers_have_no_order(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        core.arrival(df)
    assert core.arrival(df.selectExpr("id", "id AS _seq")).columns == ["id", "_seq"]
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert core.arrival(spark.read.parquet(f"{tmp_path}/one")).count() == 10


def test_fixed_width_rows_are_picked_without_a_sort(spark):
    rows = [(k % 7, k, float(k) if k % 5 else None, k % 2 == 0) for k in range(100)]
    df = spark.createDataFrame(rows, "key long, _seq long, x double, b boolean")
    for pick, best in ((core.last_by, max), (core.first_by, min)):
        out = pick(df, ["key"])
        want = {k: best((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in range(7)}
        assert {r["key"]: tuple(r) for r in out.collect()} == want and out.columns == df.columns
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert core.last_by(df.select("key"), ["key"], "key").count() == 7
    mixed = core.last_by(df.withColumn("s", F.col("x").cast("string")), ["key"])
    assert {r["key"]: r["s"] for r in mixed.collect()}[1] == "99.0"
