import time

from tallyspark import connect, watch
from tallyspark.streaming import changes


def put(spark, folder, rows, n):
    spark.createDataFrame(rows, "Sym string, Last double, _seq long").coalesce(1).write.mode("append").parquet(f"{folder}")
    time.sleep(0.1)


def test_watch_delivers_matching_added_rows_once(spark, tmp_path):
    folder = str(tmp_path / "q")
    put(spark, folder, [("A", 140.0, 1)], 0)
    stream = spark.readStream.schema("Sym string, Last double, _seq long").parquet(folder)
    port = connect({"quote": stream})
    got, once = [], []
    w = watch(port.table("quote"), lambda t: got.append(t.to_pylist()), predicate="Last > 150")
    o = watch(port.table("quote"), lambda t: once.append(t.num_rows), predicate="Last > 150", once=True)
    w._query.processAllAvailable()
    assert got == []  # the batch without matches was not delivered
    for k in range(2):
        put(spark, folder, [("A", 155.0 + k, 2 + k), ("A", 1.0, 9)], k)
        w._query.processAllAvailable()
        for _ in range(100):
            if once or not o._query.isActive:
                break
            time.sleep(0.1)
    assert [r["Last"] for batch in got for r in batch] == [155.0, 156.0]
    for _ in range(100):
        if not o._query.isActive:
            break
        time.sleep(0.1)
    assert once == [1] and o.cancelled and not o._query.isActive
    w.cancel()
    for _ in range(100):
        if not w._query.isActive:
            break
        time.sleep(0.1)
    assert not w._query.isActive and w.failure is None


def test_live_view_delivers_changed_keys(spark, tmp_path):
    folder = str(tmp_path / "q")
    put(spark, folder, [("A", 1.0, 1), ("B", 2.0, 2), ("A", None, 3)], 0)
    stream = spark.readStream.schema("Sym string, Last double, _seq long").parquet(folder)
    live = changes.live_last_by(stream, ["Sym"])
    port = connect({"quote": live})
    got = []
    s = changes.subscribe(port.table("quote"), lambda t: got.append(sorted((r["Sym"], r["Last"]) for r in t.to_pylist())), mode="update")
    s._query.processAllAvailable()
    put(spark, folder, [("A", 9.0, 4)], 1)
    s._query.processAllAvailable()
    s.cancel()
    assert got == [[("A", None), ("B", 2.0)], [("A", 9.0)]]


def settle(condition):
    for _ in range(150):
        if condition():
            return True
        time.sleep(0.1)
    return False


def test_live_account_cash_and_positions(spark, tmp_path):
    schema = "Account string, Key string, Currency string, DoubleValue double, ReceiveTime timestamp, _seq long"
    rows = [("A", "NetLiquidation", "USD", 10.0, None, 1), ("A", "BuyingPower", "USD", 5.0, None, 2), ("B", "BuyingPower", "USD", 7.0, None, 3), ("A", "$LEDGER-CashBalance", "EUR", 3.0, None, 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/o")
    got = {}
    queries = [
        changes.subscribe(connect({name: live}).table(name), lambda t, name=name: got.setdefault(name, []).append(t.to_pylist()), mode="update")
        for name, live in (("account", changes.live_account(stream)), ("cash_balance", changes.live_cash_balance(stream)))
    ]
    for q in queries:
        q._query.processAllAvailable()
    assert [(r["Account"], r["NetLiquidation"], r["BuyingPower"]) for r in got["account"][0]] == [("A", 10.0, 5.0)]
    assert [(r["Account"], r["Currency"], r["CashBalance"]) for r in got["cash_balance"][0]] == [("A", "EUR", 3.0)]
    spark.createDataFrame([("A", "NetLiquidation", "USD", 11.0, None, 5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/o")
    for q in queries:
        q._query.processAllAvailable()
        q.cancel()
    assert [(r["NetLiquidation"], r["BuyingPower"]) for r in got["account"][-1]] == [(11.0, 5.0)]


def test_batches_are_joined_with_the_table_as_it_is_then(spark, tmp_path):
    put(spark, str(tmp_path / "q"), [("A", 1.0, 5), ("A", 2.0, 1)], 0)
    stream = spark.readStream.schema("Sym string, Last double, _seq long").parquet(str(tmp_path / "q"))
    right = [[("A", 0, 100.0)]]
    got = []
    query = changes.asof_against(
        stream, lambda: spark.createDataFrame(right[0], "Sym string, _seq long, Bid double"), ["Sym", "_seq"], ["Bid"], lambda batch, n: got.append(sorted((r["Last"], r["Bid"]) for r in batch.collect()))
    )
    query.processAllAvailable()
    right[0] = [("A", 0, 100.0), ("A", 6, 200.0)]
    put(spark, str(tmp_path / "q"), [("A", 3.0, 7), ("B", 4.0, 8)], 1)
    query.processAllAvailable()
    query.stop()
    assert got == [[(1.0, 100.0), (2.0, 100.0)], [(3.0, 200.0), (4.0, None)]]


def test_a_failed_source_is_empty_and_warned_of(spark, tmp_path, caplog):
    from tallyspark.operators import market
    from tallyspark.plans import views

    put(spark, str(tmp_path / "q"), [("A", 1.0, 5)], 0)
    stream = spark.readStream.schema("Sym string, Last double, _seq long").parquet(str(tmp_path / "q"))

    def fail(batch, n):
        raise RuntimeError("gone")

    query = stream.writeStream.foreachBatch(fail).start()
    assert settle(lambda: query.exception() is not None)
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "RequestId long, Close double")
    for _ in range(2):
        assert views.raw_rows(df, "Close > 2", query).count() == 0
    assert "has failed" in caplog.text and "gone" not in [r.levelname for r in caplog.records]
    assert {k: t.count() for k, t in market.bar_tables(df, {"A": 1, "B": 9}, query).items()} == {"A": 0, "B": 0}
    fine = type("Query", (), {"exception": lambda self: None})()
    assert views.raw_rows(df, "Close > 2", fine).count() == 1
    tables = market.bar_tables(df, {"A": 1, "B": 9}, fine)
    assert [(r["Sym"], r["Close"]) for r in tables["A"].collect()] == [("A", 2.0)] and tables["B"].count() == 0 and tables["B"].columns == tables["A"].columns and market.bar_tables(df, {}) == {}
