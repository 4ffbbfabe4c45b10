import pytest
from pyspark.sql import functions as F

from tallyspark.plans import views as V
from tallyspark.types import CATALOG


def frame(spark, schema, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", _seq long")


def one(df, **key):
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return [r.asDict() for r in df.collect()]


def test_positions_collapse_to_the_last_and_get_marks_of_their_account(spark):
    pos = frame(spark, "Account string, ContractId long, Symbol string, Position double, AvgCost double, Multiplier string", ("U1", 1, "AAPL", 10.0, 1.0, ""), ("U1", 1, "AAPL", 20.0, 1.5, "1"), ("U2", 1, "AAPL", 5.0, 1.0, "x"))
    marks = frame(spark, "ContractId long, Account string, Symbol string, MarketPrice double, MarketValue double, UnrealizedPnL double", (1, "U1", "AAPL", 148.0, 1.0, 1.0), (1, "U1", "AAPL", 152.0, 2.0, 3.0))
    got = V.positions({"accounts_positions": pos, "accounts_portfolio": marks})
    a, b = one(got, Account="U1")[0], one(got, Account="U2")[0]
    assert (a["Qty"], a["MarketPrice"], a["UnrealizedPnl"], a["Multiplier"]) == (20.0, 152.0, 3.0, 1.0)
    assert b["MarketPrice"] is None and b["Multiplier"] is None
    assert got.drop("_seq").columns == CATALOG["position"].names
    port = frame(spark, "Account string, ContractId long, Symbol string, Position double, MarketPrice double", ("U1", 9, "X", 1.0, 2.0))
    assert one(V.positions({"accounts_positions": pos.limit(0), "accounts_portfolio": port}))[0]["MarketPrice"] == 2.0


def test_executions_are_never_collapsed_and_commissions_change_sign(spark):
    ex = frame(spark, "ExecId string, Symbol string, Side string, Shares double, Price double, Multiplier double", ("e", "A", "BOT", 1.0, 2.0, 100.0), ("e", "A", "SLD", 1.0, 2.0, 100.0), ("f", "A", "ODD", 1.0, 2.0, 1.0))
    fee = frame(spark, "ExecId string, ReceiveTime timestamp, Commission double, Currency string, RealizedPNL double", ("e", None, 1.25, "USD", 12.0), ("e", None, 1.10, "USD", 13.0))
    got = V.apply_view(V.VIEWS["execution"], {"orders_exec_details": ex, "orders_exec_commission_report": fee})
    assert sorted((r["Side"], r["Commission"]) for r in got.collect()if r["ExecId"] == "e") == [("BUY", -1.10), ("SELL", -1.10)]
    assert one(got, ExecId="f")[0]["Commission"] is None and one(got, ExecId="f")[0]["Side"] == "ODD"
    last = one(V.apply_view(V.VIEWS["commission"], {"orders_exec_commission_report": fee}))
    assert len(last) == 1 and last[0]["Commission"] == -1.10 and last[0]["RealizedPnl"] == 13.0


def test_unset_marks_become_null(spark):
    m = V.UNSET
    pnl = frame(spark, "Account string, ConId string, DailyPnL double, UnrealizedPnL double, RealizedPnL double, Value double", ("D", "5", m, -m, float("nan"), 15000.0), ("D", "", 10.0, 200.0, 5.0, m), ("D", "bad", 1.0, 1.0, 1.0, 1.0))
    held = frame(spark, "Account string, ContractId long, Symbol string", ("D", 5, "EARLY"), ("D", 5, "LATE"))
    rows = V.apply_view(V.VIEWS["position_pnl"], {"accounts_pnl_single": pnl, "accounts_positions": held}).orderBy("_seq").collect()
    assert [(r["ConId"], r["Sym"], r["DailyPnl"], r["UnrealizedPnl"], r["RealizedPnl"], r["MarketValue"]) for r in rows] == [(5, "LATE", None, None, None, 15000.0), (None, None, 10.0, 200.0, 5.0, None), (None, None, 1.0, 1.0, 1.0, 1.0)]
    assert V.pnl_snapshot(pnl, spark.createDataFrame([(5, "X")], "ConId long, Sym string")).where("Sym = 'X'").count() == 1


def test_pivots(spark):
    o = frame(spark, "Account string, Currency string, Key string, Value string, DoubleValue double", ("A", "USD", "NetLiquidation", "", 1e6), ("A", "USD", "BuyingPower", "", 5e5), ("A", "USD", "NetLiquidation", "", 2e6), ("A", None, "MaintMarginReq", "", 2e4), ("B", "USD", "BuyingPower", "", 1.0), ("A", "USD", "$LEDGER-CashBalance", "", 1e5), ("A", "EUR", "$LEDGER-CashBalance", "", 5e3), ("A", "EUR", "$LEDGER-ExchangeRate", "", 1.08), ("A", "GBP", "$LEDGER-ExchangeRate", "", 1.3), ("A", None, "$LEDGER-CashBalance", "", 9.0)).withColumn("ReceiveTime", F.lit("2026-01-01").cast("timestamp"))
    a = one(V.account(o))
    assert len(a) == 1 and (a[0]["NetLiquidation"], a[0]["MaintMargin"], a[0]["Currency"], a[0]["TotalCashValue"]) == (2e6, 2e4, "USD", None)
    cash = {r["Currency"]: r for r in V.cash_balance(o).collect()}
    assert set(cash) == {"USD", "EUR"} and cash["EUR"]["ExchangeRate"] == 1.08 and cash["USD"]["ExchangeRate"] is None
    assert V.account(o, "B").count() == 0 and V.account_snapshot(o).first()["NetLiquidation"] == 2e6


def test_every_view_gives_its_declared_columns(spark):
    for name, v in V.VIEWS.items():
        raw = spark.createDataFrame([], ", ".join(f"`{c}` {'timestamp' if 'Time' in c else 'string'}" for c in v.names) + ", _seq long")
        got = V.apply_view(v, {v.source: raw})
        assert got.columns == [*CATALOG[name].names, "_seq"] and got.count() == 0
        CATALOG[name].validate(got)


def test_severity_is_computed_where_the_feed_has_none(spark):
    raw = frame(spark, "ReceiveTime timestamp, ErrorCode int, ErrorDescription string", (None, 10167, "x"), (None, 502, "y"))
    got = V.apply_view(V.VIEWS["errors"], {"errors": raw}).orderBy("Code").collect()
    assert [r["Severity"] for r in got] == ["GENUINE_ERROR", "INFORMATIONAL"]
    with pytest.raises(KeyError):
        V.apply_view(V.VIEWS["news"], {})


def test_snapshots(spark):
    pos = frame(spark, "Account string, ContractId long, Symbol string, Position double", ("U1", 1, "A", 1.0), ("U2", 2, "B", 2.0))
    raw = {"accounts_positions": pos}
    assert V.raw_rows(pos, "Account == 'U1' && Position > 0").count() == 1 and V.raw_rows(pos).count() == 2
    assert V.table_snapshot("position", raw, "U2").collect()[0]["Sym"] == "B" and V.table_snapshot("position", raw).count() == 2
    nothing = V.table_snapshot("order", raw)
    assert nothing.count() == 0 and nothing.columns == CATALOG["order"].names
    with pytest.raises(ValueError):
        V.raw_rows(pos, "Nope > 1")
