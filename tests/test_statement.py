import math
from datetime import datetime

import pytest

from tallyspark import StatementError
from tallyspark.functions.stamps import decimal_text, moment, number
from tallyspark.operators.summary import performance_of, performance_summary, statement_performance
from tallyspark.sources import statement as S

NAVS = (1_000_000, 1_001_000, 1_000_400, 1_002_500, 1_004_000, 1_004_580)


def nav_rows(values, account="U1", first=1):
    return "".join(f'<EquitySummaryByReportDateInBase accountId="{account}" reportDate="202606{first + i:02d}" total="{v}" cash="1" stock="2"/>' for i, v in enumerate(values))


def envelope(*bodies):
    return "<FlexQueryResponse><FlexStatements>" + "".join(f"<FlexStatement>{b}</FlexStatement>" for b in bodies) + "</FlexStatements></FlexQueryResponse>"


TRADES = """<Trades>
<Trade symbol="AAPL" accountId="U1" dateTime="20260602;094850" assetCategory="STK" quantity="100" buySell="BUY" tradePrice="314.18" ibCommission="-1" ibExecID="x1" conid="265598" levelOfDetail="EXECUTION"/>
<Trade symbol="AAPL" dateTime="20260602;094850" quantity="100" buySell="BUY" tradePrice="314.18" ibExecID="x1" levelOfDetail="ORDER"/>
<Trade accountId="U1" symbol="AAPL" tradeDate="20260603" quantity="-100" buySell="SELL" tradePrice="320" fifoPnlRealized="581" tradeID="t2" multiplier="abc" levelOfDetail="execution"/>
<Trade accountId="U1" symbol="EUR.USD" dateTime="2026-06-03T10:00:00-04:00" quantity="-12345678.5" tradePrice="1.08"/>
<Trade accountId="U1" symbol="EUR.USD" dateTime="2026-06-03T10:00:00-04:00" quantity="-12345678.5" tradePrice="1.08"/>
<Trade accountId="U1" symbol="NOPE" dateTime="soon" quantity="1" tradePrice="1"/>
<Trade accountId="U1" symbol="NOPE" dateTime="20260603" quantity="" tradePrice="1"/>
<Trade accountId="U1" symbol="AAPL" dateTime="20260604" quantity="1" tradePrice="5" ibExecID="x1"/>
</Trades>"""


def test_moments_and_numbers(spark):
    cases = {
        "2026-06-12T10:31:07.123456-04:00": datetime(2026, 6, 12, 14, 31, 7, 123456), "2026-06-02T10:31:00-0400": datetime(2026, 6, 2, 14, 31), "2026-06-02T10:31:09.5": datetime(2026, 6, 2, 14, 31, 9, 500000), "2026-06-02T10:31:00": datetime(2026, 6, 2, 14, 31),
        "2026-06-02 10:31:00": datetime(2026, 6, 2, 14, 31), "2026-01-02": datetime(2026, 1, 2, 5), "20260602;094850": datetime(2026, 6, 2, 13, 48, 50), " 20260602 094850 ": datetime(2026, 6, 2, 13, 48, 50), "20260608": datetime(2026, 6, 8, 4),
        "2026-03-08T01:59:59": datetime(2026, 3, 8, 6, 59, 59), "2026-03-08T03:00:00": datetime(2026, 3, 8, 7), "": None, "   ": None, "soon": None, "20261399": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", moment(df.x).cast("timestamp_ntz")).collect()}
    assert got == cases
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("",), ("x",), (None,), ("-3e2",)], "x string")
    assert [r[0] for r in df.select(number(df.x)).collect()] == [1.5, 2.0, None, None, None, -300.0]


def test_decimal_text_is_pythons(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1e7, 12345678.5, 1.5e15, 1e16, 1e-3, 5e-4, 1.25e-4, 5e-5, 1.5e-7, 123456.789, 9999999.0, 10000000.0, -7.25e8, 1e100, 314.18]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(decimal_text(df.x)).collect()] == [repr(v) for v in values]


def test_executions(spark):
    s = S.load(spark, envelope(TRADES))
    rows = {r["ExecId"]: r for r in s.tables["execution"].collect()}
    made = [k for k in rows if k.startswith("synx-")]
    assert set(rows) == {"x1", "t2", *made} and len(made) == 1
    assert made[0] == "synx-" + __import__("hashlib").sha1(b"U1|EUR.USD|2026-06-03T10:00:00-04:00|-12345678.5|1.08").hexdigest()[:16]
    assert rows["x1"]["Price"] == 314.18 and rows["x1"]["ConId"] == 265598 and rows["t2"]["Qty"] == 100 and rows["t2"]["Multiplier"] == 1.0
    assert rows[made[0]]["Side"] == "" and rows["x1"]["Liquidity"] is None
    report = {(r["table"], r["outcome"]): r["rows"] for r in s.report.collect()}
    assert report["execution", "kept"] == 3 and report["execution", "dropped: timestamp"] == 1 and report["execution", "dropped: symbol, price or quantity"] == 1
    assert report["execution", "repeated"] == 1 and report["execution", "repeated synthetic"] == 1


def test_cash_and_transfers(spark):
    body = """<CashTransactions>
<CashTransaction accountId="U1" type="Dividends" symbol="AAPL" dateTime="20260602" amount="12.5" currency="USD" transactionID="7"/>
<CashTransaction accountId="U1" type="Fees" dateTime="20260602" amount="" currency="USD"/>
<CashTransaction accountId="U1" type="Fees" dateTime="" amount="3" currency="USD"/>
</CashTransactions><Transfers>
<Transfer accountId="U1" symbol="A" date="20260602" direction="IN" positionAmountInBase="1080" fxRateToBase="1.08" currency="EUR"/>
<Transfer accountId="U1" symbol="B" date="20260602" direction="out" positionAmountInBase="1080" positionAmount="1000" currency="EUR"/>
<Transfer accountId="U1" symbol="C" date="20260602" quantity="-10" transferPrice="5" currency="USD"/>
<Transfer accountId="U1" symbol="D" date="20260602" direction="IN" quantity="10" currency="USD"/>
</Transfers>"""
    s = S.load(spark, envelope(body))
    rows = {r["Sym"]: r for r in s.tables["cash"].collect()}
    assert {k: round(r["Amount"], 9) for k, r in rows.items()} == {"AAPL": 12.5, "A": 1000.0, "B": -1000.0, "C": 50.0}
    assert rows["AAPL"]["TxnId"] == "7" and rows["A"]["TxnId"].startswith("syn-") and rows["A"]["Type"] == "Transfer"
    report = {(r["table"], r["outcome"]): r["rows"] for r in s.report.collect()}
    assert report["cash", "dropped: amount"] == 2 and report["cash", "dropped: timestamp"] == 1
    assert s.corporate_actions.count() == 4


def test_replies():
    assert S.parse("<x").status == "error" and S.parse("<FlexQueryResponse/>").status == "error"
    wait = "<FlexStatementResponse><ErrorCode>1019</ErrorCode><ErrorMessage>later</ErrorMessage></FlexStatementResponse>"
    assert S.parse(wait).status == "in_progress" and S.parse(wait.replace("1019", "1012")).status == "fail"
    for bad in ("<x", wait, wait.replace("1019", "1012")):
        with pytest.raises(StatementError):
            S.parse_or_raise(bad)
    assert S.send_reply("<R><Status>Success</Status><ReferenceCode>5</ReferenceCode><Url>u</Url></R>") == {"status": "Success", "reference_code": "5", "url": "u"}
    assert S.send_reply("<R><Status>Fail</Status><ErrorCode>1</ErrorCode></R>")["status"] == "Fail"
    assert S.parse(envelope("<Odd><Row/></Odd><Odd><Row/></Odd>")).unparsed == ["Odd"]


def test_performance_of_a_statement(spark, tmp_path, capsys):
    text = envelope(nav_rows(NAVS))
    p = statement_performance(spark, text)
    returns = [b / a - 1 for a, b in zip(NAVS, NAVS[1:])]
    mean = sum(returns) / 5
    sd = math.sqrt(sum((r - mean) ** 2 for r in returns) / 4)
    assert p.num_periods == 5 and p.account == "U1" and p.starting_nav == 1_000_000 and p.ending_nav == 1_004_580
    assert p.cumulative_return == pytest.approx(0.00458) and p.max_drawdown == pytest.approx(1_000_400 / 1_001_000 - 1) and p.hit_rate == 0.8
    assert p.sharpe_ratio == pytest.approx((mean - 0.0378 / 252) / sd * math.sqrt(252)) and p.calmar_ratio == pytest.approx(p.annualized_return / abs(p.max_drawdown))
    assert "Sharpe" in p.render() and p.as_dict()["start"].startswith("2026-06-01")
    from tallyspark.__main__ import main

    path = tmp_path / "s.xml"
    path.write_text(text)
    assert main([str(path), "--json"]) == 0 and '"hit_rate": 0.8' in capsys.readouterr().out
    assert main([str(path)]) == 0 and main([str(path), "--risk-free", "x"]) == 2 and main(["/nowhere.xml"]) == 2 and main([str(path), "--account", "U9"]) == 2


def test_flows_are_stripped_by_local_day(spark):
    def perf(cash, navs=(100_000, 110_000)):
        return statement_performance(spark, envelope(nav_rows(navs, first=5) if len(navs) > 2 else f'<EquitySummaryByReportDateInBase accountId="U1" reportDate="20260605" total="{navs[0]}"/><EquitySummaryByReportDateInBase accountId="U1" reportDate="20260608" total="{navs[1]}"/>', f"<CashTransactions>{cash}</CashTransactions>"))

    deposit = '<CashTransaction accountId="U1" type="Deposits &amp; Withdrawals" dateTime="{}" amount="10000" currency="USD"/>'
    for day in ("20260606", "20260608", "20260608;233000"):  # a Saturday, a Monday, a Monday evening that is Tuesday in UTC
        p = perf(deposit.format(day))
        assert p.cumulative_return == pytest.approx(0.0) and p.net_external_flows == 10000 and p.flows_applied
    assert perf(deposit.format("20260609")).cumulative_return == pytest.approx(0.1)
    fx = '<CashTransaction accountId="U1" type="Deposits" dateTime="20260608" amount="1000" currency="EUR" fxRateToBase="1.08"/>'
    assert perf(fx).net_external_flows == pytest.approx(1080)
    assert perf(fx.replace(' fxRateToBase="1.08"', "")).net_external_flows == 0


def test_accounts_must_be_told_apart(spark):
    two = envelope(nav_rows(NAVS), nav_rows((5, 6), "U2"))
    with pytest.raises(ValueError):
        statement_performance(spark, two)
    assert statement_performance(spark, two, account="U2").cumulative_return == pytest.approx(0.2)
    with pytest.raises(ValueError):
        statement_performance(spark, envelope(nav_rows(NAVS), '<CashTransactions><CashTransaction accountId="U3" type="Fees" dateTime="20260602" amount="1"/></CashTransactions>'))
    port = S.load_port(spark, two)
    assert performance_summary(port, account="U1").num_periods == 5
    assert "nav" not in S.load_port(spark, envelope(TRADES))._tables


def test_degenerate_navs(spark):
    nav = lambda vs: spark.createDataFrame([(datetime(2026, 1, i + 1), float(v)) for i, v in enumerate(vs)], "Timestamp timestamp, Total double")
    for bad in ([], [1], [0, 5]):
        with pytest.raises(ValueError):
            performance_of(nav(bad))
    p = performance_of(nav([100, 100, 100]))
    assert math.isnan(p.sharpe_ratio) and math.isnan(p.calmar_ratio) and p.max_drawdown == 0.0
    with pytest.raises(ValueError):
        performance_of(spark.createDataFrame([], "Timestamp timestamp, x double"))


def test_folder_of_statements(spark, tmp_path):
    (tmp_path / "a.xml").write_text(envelope(TRADES, nav_rows(NAVS)))
    (tmp_path / "b.xml").write_text(envelope(nav_rows(NAVS)))
    s = S.canonicalize(S.read_folder(spark, str(tmp_path)))
    assert s.tables["execution"].count() == 3 and s.tables["nav"].count() == 6


def trade(exec_id, price, **more):
    return f'<Trade accountId="U1" symbol="A" dateTime="20260602" quantity="1" tradePrice="{price}" ibExecID="{exec_id}" ' + " ".join(f'{k}="{v}"' for k, v in more.items()) + "/>"


def test_files_of_a_folder_count_in_the_order_of_their_names(spark, tmp_path):
    """A larger file is read first by Spark, and still the file first by name wins; within a file the first row does."""
    change = '<ChangeInNAV accountId="U1" startingValue="{}"/>'
    (tmp_path / "a.xml").write_text(envelope(f"<Trades>{trade('x', 1.0)}</Trades><Trades>{trade('y', 5.0)}</Trades>{change.format(1)}{change.format(2)}", change.format(3)))
    (tmp_path / "b.xml").write_text(envelope(f"<Trades>{trade('x', 2.0)}{trade('z', 3.0)}{trade('z', 4.0)}</Trades>" + "<!-- long -->" * 5000, f"<Trades>{trade('y', 6.0)}</Trades><EquitySummaryInBase>{nav_rows(NAVS)}</EquitySummaryInBase>"))
    (tmp_path / "c.xml").write_text("<FlexStatementResponse><Status>Fail</Status><ErrorCode> 1019 </ErrorCode><ErrorMessage>later</ErrorMessage></FlexStatementResponse>")
    (tmp_path / "d.xml").write_text("<FlexStatementResponse><ErrorCode>1012</ErrorCode></FlexStatementResponse>")
    (tmp_path / "e.xml").write_text("<FlexQueryResponse/>")
    sections = S.read_folder(spark, str(tmp_path))
    s = S.canonicalize(sections)
    assert {r["ExecId"]: r["Price"] for r in s.tables["execution"].collect()} == {"x": 1.0, "y": 5.0, "z": 3.0}
    assert s.tables["nav"].count() == 6 and sorted(r["startingValue"] for r in s.nav_changes.collect()) == [1.0, 3.0]
    order = [r["ibExecID"] for r in sections["trades"].orderBy("_seq").collect()]
    assert order == ["x", "y", "x", "z", "z", "y"] and sections["trades"].select("_seq").distinct().count() == 6
    together = S.parse(envelope(f"<Trades>{trade('x', 1.0)}</Trades>")).rows
    assert together["trades"][0]["ibExecID"] == "x"
    replies = {r["file"].rsplit("/", 1)[1]: (r["status"], r["code"], r["message"]) for r in S.folder_replies(spark, str(tmp_path)).collect()}
    assert replies == {"a.xml": ("ok", "", ""), "b.xml": ("ok", "", ""), "c.xml": ("in_progress", "1019", "later"), "d.xml": ("fail", "1012", ""), "e.xml": ("error", "", "")}


def test_numbers_that_cannot_be_read_are_warned_of(spark, caplog):
    text = envelope(f"<Trades>{trade('x', 'many')}{trade('y', 2)}</Trades><Odd><Row/></Odd>")
    s = S.load(spark, text)
    assert s.tables["execution"].count() == 1 and "'many'" in caplog.text and "Odd" in caplog.text
    found = [tuple(r) for r in S.unreadable(S.frames(spark, S.parse(text))).collect()]
    assert found == [("trades", "tradePrice", 1, "many")]


def test_base_currency_in_any_case(spark, caplog):
    from tallyspark.operators import returns as R

    rows = [("A", "Deposits", datetime(2026, 6, 2, 12), a, c, None) for a, c in ((100.0, "usd"), (50.0, " USD\t"), (7.0, "USD"), (3.0, None), (1000.0, "EUR"), (500.0, ""))]
    cash = spark.createDataFrame(rows, "Account string, Type string, Timestamp timestamp, Amount double, Currency string, FxRateToBase double")
    assert [r["amount"] for r in R.external_flows(cash).collect()] == [160.0]
    assert [r["amount"] for r in R.external_flows(cash, " eur ").collect()] == [1003.0]
    assert sorted(r["Amount"] for r in R.skipped_flows(cash).collect()) == [500.0, 1000.0]
    assert R.warn_of_skipped(cash) == 2 and "1000.0 EUR" in caplog.text and R.skipped_flows(cash.drop("Type")).count() == 0
    assert R.external_flows(cash.drop("Currency", "FxRateToBase")).first()["amount"] == 1660.0
