import pyarrow as pa
import pytest

from tallyspark import UnknownTable, connect
from tallyspark.types import DType


@pytest.fixture(scope="module")
def port(spark):
    ex = spark.sql("SELECT 'e1' AS ExecId, timestamp'2024-01-02 10:00:01' AS Timestamp, 'AAPL' AS Sym, 'BUY' AS Side, 10.0D AS Qty, 155.0D AS Price, 7L AS ConId, 1L AS _seq UNION ALL SELECT 'e2', timestamp'2024-01-02 11:00:00', 'MSFT', 'SELL', 5.0D, 290.0D, NULL, 2L UNION ALL SELECT 'e3', timestamp'2024-01-02 12:00:00', 'AAPL', 'BUY', 1.0D, 140.0D, 9223372036854775807L, 3L")
    q = spark.sql("SELECT 'AAPL' AS Sym, timestamp'2024-01-02 10:00:00' AS Timestamp, 154.9D AS Bid, 155.1D AS Ask, 1L AS _seq")
    return connect({"execution": ex, "quote": q, "scratch": q})


def test_lookup(port):
    assert port.table("quote").schema.name == "quote"
    for name in ("nope", "nav", "scratch"):
        with pytest.raises(UnknownTable):
            port.table(name)


def test_snapshot_has_canonical_types(port):
    t = port.table("execution").snapshot()
    assert str(t.schema.field("Timestamp").type) == "timestamp[ns, tz=UTC]"
    assert t["ConId"].type == pa.int64() and None in t["ConId"].to_pylist()
    assert "_seq" not in t.column_names


def test_operations(port):
    ex = port.table("execution")
    assert port.filter(ex, "Price > 150").snapshot()["ExecId"].to_pylist() == ["e1", "e2"]
    assert port.filter(ex, "Price > 150").schema is ex.schema
    assert port.time_window(ex, column="Timestamp", start="2024-01-02T10:00:01Z", end="2024-01-02T06:00:00-05:00").snapshot().num_rows == 2
    assert port.sort(ex, keys=[("Sym", True), ("Price", False)]).snapshot()["ExecId"].to_pylist() == ["e2", "e3", "e1"]
    g = port.group_by(ex, aggs={"Qty": "sum", "Price": "last", "n": "count"}, by=["Sym"])
    assert g.schema.names == ["Sym", "Qty", "Price", "n"] and g.schema.name == "<derived>"
    assert sorted(map(tuple, (r.values() for r in g.snapshot().to_pylist()))) == [("AAPL", 11.0, 140.0, 2), ("MSFT", 5.0, 290.0, 1)]
    j = port.as_of_join(ex, port.table("quote"), joins=["Bid", "Ask"], on=["Sym", "Timestamp"]).snapshot().to_pylist()
    assert {(r["ExecId"], r["Bid"]) for r in j} == {("e1", 154.9), ("e2", None), ("e3", 154.9)}


def test_wrong_arguments_are_value_errors(port):
    ex = port.table("execution")
    bad = [
        lambda: port.filter(ex, "Sym > Qty"),
        lambda: port.filter(ex, "Nope > 1"),
        lambda: port.time_window(ex, column="Sym", start="2024-01-01", end="2024-01-02"),
        lambda: port.time_window(ex, column="Timestamp", start="soon", end="2024-01-02"),
        lambda: port.group_by(ex, aggs={"Qty": "median"}, by=["Sym"]),
        lambda: port.group_by(ex, by=["Sym"], aggs={"Side": "sum"}),
        lambda: port.group_by(ex, by=["Nope"], aggs={}),
        lambda: port.sort(ex, keys=[("Nope", True)]),
        lambda: port.derive(ex, columns={"x": "Sym + 1"}),
        lambda: port.derive(ex, columns={"a b": "Qty"}),
        lambda: port.derive(ex, columns={"x": "Qty", "y": "x + 1"}),
        lambda: port.as_of_join(ex, port.table("quote"), on=["Timestamp", "Sym"], joins=["Bid"]),
        lambda: port.as_of_join(ex, port.table("quote"), on=[], joins=["Bid"]),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        port.derive(ex, columns={"x": "ConId + 1"}).snapshot()  # overflow


def test_derive_and_registry(port):
    made = port.table("execution").derive(Worth="Qty * Price", Buy="Side == 'BUY'")
    assert made.schema.dtype("Worth") is DType.FLOAT64 and made.schema.dtype("Buy") is DType.BOOL
    assert made.snapshot()["Worth"].to_pylist() == [1550.0, 1450.0, 140.0]
    first = port.register_derived("worth", base="execution", columns={"Worth": "Qty * Price"})
    assert port.table("worth") is first and port.derived_origin("worth") == "untrusted" and port.derived_origin("quote") is None
    assert port.derived_schema("worth").names[-1] == "Worth" and port.derived_schema("nope") is None
    for name in ("worth", "nav", "scratch"):
        with pytest.raises(ValueError):
            port.register_derived(name, base="quote", columns={})
    assert port.dataframe("quote").count() == 1
