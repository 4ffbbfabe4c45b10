import math
import statistics
from datetime import date, datetime, timedelta

import pytest

from tallyspark.functions.rates import duration, risk_free
from tallyspark.operators import benchmark as B
from tallyspark.operators import diagnostics as D
from tallyspark.operators import market as M
from tallyspark.operators import returns as R
from tallyspark.operators import roundtrips as RT
from tallyspark.operators.summary import journal_of, relative_metrics, relative_summary
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 28)


def nav(spark, values, account="A"):
    return spark.createDataFrame([(account, T0 + timedelta(days=i), float(v)) for i, v in enumerate(values)], "Account string, Timestamp timestamp, Total double")


def grow(returns, start=100.0):
    out = [start]
    for r in returns:
        out.append(out[-1] * (1 + r))
    return out


def test_rates_and_durations():
    assert risk_free()[0] == risk_free("Auto")[0] == 0.0378 and risk_free("0.05")[0] == 0.05
    with pytest.raises(ValueError):
        risk_free("high")
    assert [duration(x) for x in ("1mo", "MAX", "10 y", "6Y", "3650 d")] == ["1 M", "5 Y", "10 Y", "6 Y", "3650 D"]
    for bad in ("", "5", "x y", "1.5 Y"):
        with pytest.raises(ValueError):
            duration(bad)


def test_returns_skip_a_zero_start_and_keep_accounts_apart(spark):
    both = nav(spark, [0, 100, 110]).unionByName(nav(spark, [50, 100], "B"))
    rows = {(r["Account"], str(r["later_date"])): round(r["r"], 9) for r in R.daily_returns(both).collect()}
    assert rows == {("A", "2026-01-30"): 0.1, ("B", "2026-01-29"): 1.0}


def test_flows_in_half_open_periods(spark):
    flows = spark.createDataFrame([("A", date(2026, 1, 28), 7.0), ("A", date(2026, 1, 29), 1.0), ("A", date(2026, 1, 30), 2.0), ("A", date(2026, 2, 9), 4.0), ("B", date(2026, 1, 29), 9.0)], "Account string, flow_date date, amount double")
    got = [(r["k"], r["flow"]) for r in R.periods(nav(spark, [100, 101, 103]), flows).orderBy("k").collect() if r["Account"] == "A"]
    assert got == [(0, 7.0), (1, 1.0), (2, 2.0)]
    assert R.performance(nav(spark, [100, 101, 103]), flows).where("Account = 'A'").first()["net_external_flows"] == 3.0


def test_rolling_and_periodic(spark):
    returns = [0.01, -0.02, 0.03, 0.0, -0.01, 0.02, 0.01, -0.03, 0.02]
    rows = R.rolling_performance(nav(spark, grow(returns)), window=3).orderBy("Timestamp").collect()
    assert len(rows) == 7
    for k, r in enumerate(rows):
        win = returns[k : k + 3]
        wealth = grow(win, 1.0)
        worst = min(w / max(wealth[: i + 1]) - 1 for i, w in enumerate(wealth))
        assert r["Return"] == pytest.approx(wealth[-1] - 1) and r["MaxDrawdown"] == pytest.approx(worst, abs=1e-12)
        assert r["Volatility"] == pytest.approx(statistics.stdev(win) * math.sqrt(252))
    assert R.rolling_performance(nav(spark, [1, 2]), window=3).count() == 0
    with pytest.raises(ValueError):
        R.rolling_performance(nav(spark, [1, 2]), window=1)
    months = R.periodic_returns(nav(spark, grow(returns))).orderBy("Period").collect()
    assert [r["Period"] for r in months] == ["2026-01", "2026-02"]
    assert months[0]["Return"] == pytest.approx(1.01 * 0.98 * 1.03 - 1)
    assert R.periodic_returns(nav(spark, grow(returns)), freq="quarterly").first()["Period"] == "2026-Q1"
    with pytest.raises(ValueError):
        R.periodic_returns(nav(spark, [1, 2]), freq="weekly")


def test_a_levered_portfolio_has_its_beta(spark):
    b = [0.01, -0.005, 0.02, -0.01, 0.015]
    bench = nav(spark, grow(b)).withColumnRenamed("Total", "Close").withColumn("Sym", F.lit("SPX")).drop("Account")
    s = relative_summary(nav(spark, grow([2 * x for x in b])), bench)
    assert s.beta == pytest.approx(2) and s.correlation == pytest.approx(1) and s.benchmark_label == "SPX" and s.dropped_periods == 0 and s.num_periods == 5
    assert "SPX" in s.render() and s.as_dict()["start"] == "2026-01-29"
    up = math.prod(1 + 2 * x for x in b if x > 0) - 1
    assert s.up_capture == pytest.approx(up / (math.prod(1 + x for x in b if x > 0) - 1))
    gap = bench.where("Timestamp <> '2026-01-30'")
    both = B.aligned(R.daily_returns(nav(spark, grow(b))), R.daily_returns(gap, value_column="Close"))
    assert both.count() == 3
    with pytest.raises(ValueError):
        relative_summary(nav(spark, grow(b)), bench.where("Timestamp >= '2026-02-01'"))
    flat = relative_summary(nav(spark, grow(b)), nav(spark, [1] * 6).withColumnRenamed("Total", "Close"))
    assert math.isnan(flat.beta) and math.isnan(flat.correlation)
    assert B.rolling_relative(both.unionByName(both.limit(0)), window=3).count() == 1


def test_plain_series_against_the_formulas(spark):
    p, b = [0.01, -0.02, 0.015, 0.003], [0.008, -0.01, 0.02, -0.001]
    s = relative_metrics(spark, p, b)
    mp, mb, rf = statistics.mean(p), statistics.mean(b), 0.0378 / 252
    beta = statistics.covariance(p, b) / statistics.variance(b)
    active = [x - y for x, y in zip(p, b)]
    assert s.beta == pytest.approx(beta) and s.alpha_annualized == pytest.approx(((mp - rf) - beta * (mb - rf)) * 252)
    assert s.correlation == pytest.approx(statistics.correlation(p, b)) and s.r_squared == pytest.approx(s.correlation**2)
    assert s.tracking_error == pytest.approx(statistics.stdev(active) * math.sqrt(252)) and s.information_ratio == pytest.approx(statistics.mean(active) / statistics.stdev(active) * math.sqrt(252))
    assert s.down_capture == pytest.approx((0.98 * 1.003 - 1) / (0.99 * 0.999 - 1)) and s.benchmark_label == "<returns>" and "From" not in s.render()
    for bad in (([0.1], [0.1]), ([0.1, 0.2], [0.1])):
        with pytest.raises(ValueError):
            relative_metrics(spark, *bad)


def fills(spark, rows):
    return spark.createDataFrame([(s, side, float(q), float(p), T0 + timedelta(minutes=m), float(pnl), float(fee), 1.0, "x", i) for i, (s, side, q, p, m, pnl, fee) in enumerate(rows)], "Sym string, Side string, Qty double, Price double, Timestamp timestamp, RealizedPnl double, Commission double, Multiplier double, Strategy string, _seq long")


def test_round_trips(spark):
    df = fills(spark, [
        ("P", "BUY", 100, 10, 0, 0, -1), ("P", "SELL", 40, 11, 1, 40, -1), ("P", "SELL", 60, 12, 2, 120, -1),
        ("F", "BUY", 10, 5, 0, 0, -2), ("F", "SELL", 20, 6, 1, 10, -12), ("F", "BUY", 10, 4, 2, 20, 0),
        ("O", "SELL", 5, 9, 0, 0, 0), ("S", "BUY", 1, 1, 0, 3, 0), ("S", "SELL", 1, 2, 0, 1, 0),
    ])
    t = {(r["Sym"], r["trip"]): r for r in RT.round_trips(df).collect()}
    p = t["P", 1]
    assert p["avg_exit_price"] == pytest.approx(11.6) and p["realized_pnl"] == 160 and p["hold_seconds"] == 120 and p["return_pct"] == pytest.approx(0.16) and not p["suspect"]
    assert (t["F", 1]["direction"], t["F", 1]["commission"], t["F", 2]["direction"], t["F", 2]["commission"]) == ("long", -8, "short", -6)
    assert t["F", 1]["realized_pnl"] == 10 and t["F", 2]["realized_pnl"] == 20 and t["F", 2]["qty"] == 10
    assert t["O", 1]["is_open"] and t["O", 1]["hold_seconds"] is None and t["O", 1]["exit_ts"] is None
    assert t["S", 1]["suspect"] and t["S", 1]["realized_pnl"] == 1 and not t["S", 1]["is_open"]
    j = journal_of(df)
    assert j.aggregates["count"] == 4 and j.by_group["P"]["total_net_pnl"] == 157 and j.warnings == [{"sym": "S", "reason": "unmatched_close"}]
    assert j.by_group["P"]["avg_loss"] is None and j.by_group["P"]["profit_factor"] is None and len(j.open_round_trips) == 1 and "open_commission" not in j.as_dict()
    empty = journal_of(df.where("Sym = 'O'"))
    assert empty.aggregates["count"] == 0 and empty.aggregates["win_rate"] is None and empty.aggregates["total_net_pnl"] == 0.0
    with pytest.raises(ValueError):
        RT.journal(RT.round_trips(df), "account")


def test_diagnostics(spark):
    rows = [("1100", "lost"), ("1102", "back"), ("2103", "Market data farm connection is broken:usfarm"), ("2104", "Market data farm connection is OK:usfarm"), ("2107", "HMDS data farm connection is inactive but can be had.ushmds"), ("2150", "it is broken"), ("2176", "x"), ("10167", "delayed"), ("10089", "denied"), ("x", "no code")]
    df = spark.createDataFrame([(c, m, i) for i, (c, m) in enumerate(rows)], "ErrorCode string, ErrorDescription string, _seq long")
    got = {r["code"]: r for r in D.diagnose(df).collect()}
    assert [got[c]["tier"] for c in (1100, 1102, 2104, 2150, 2176, 10167, 10089)] == [D.DEGRADED, D.INFO, D.INFO, D.DEGRADED, D.INFO, D.DATA_WARNING, D.GENUINE]
    assert got[10089]["denied"] and got[10089]["fatal"] and not got[10167]["fatal"] and got[1102]["restored"]
    assert got[2107]["farm"]["farm"] == "ushmds" and got[2107]["farm"]["kind"] == "historical_data" and not got[2107]["farm"]["is_ok"]
    h = D.connection_health(df).first()
    assert h["farms"] == {"usfarm": True, "ushmds": False} and not h["connection_lost"] and h["genuine_errors"][0]["code"] == 10089
    assert h["summary"] == "connected; 1 genuine error(s) [10089]; farms: usfarm=OK, ushmds=BROKEN"
    lost = D.connection_health(df.where("_seq = 0"), connected=False).first()
    assert lost["connection_lost"] and lost["summary"] == "DISCONNECTED; no genuine errors; connectivity LOST"
    nothing = D.connection_health(df.where("false")).first()
    assert nothing["tier_counts"] == {} and nothing["summary"] == "connected; no genuine errors"
    counts = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 5), (4, 7), (5, 7), (6, 7), (7, 8)], "_seq long, n long")
    assert [tuple(r) for r in D.settled(counts).collect()] == [(6, 7)]


def test_market_and_options(spark):
    ticks = spark.createDataFrame([(1, "LAST", 5.0, 0), (1, "DELAYED_LAST", 6.0, 1), (1, "LAST", None, 2), (1, "ASK", 7.0, 3), (2, "HIGH", 1.0, 4)], "ContractId long, TickType string, Price double, _seq long").withColumn("ReceiveTime", F.col("_seq"))
    sizes = spark.createDataFrame([(1, "BID_SIZE", 3.0, 0)], "ContractId long, TickType string, Size double, _seq long")
    q = {r["ContractId"]: r for r in M.quote_snapshot(ticks, sizes).collect()}
    assert (q[1]["last"], q[1]["bid"], q[1]["ask"], q[1]["bid_size"], q[1]["timestamp"]) == (6.0, None, 7.0, 3.0, 3) and q[2]["last"] is None
    assert [r["_seq"] for r in M.last_rows(ticks, "ContractId", 2).orderBy("_seq").collect()] == [2, 3, 4]
    assert M.last_rows(ticks, "ContractId", 0).count() == 5
    bars = spark.createDataFrame([(10, 555, 100.0), (20, 555, 102.1), (10, 555, 101.0)], "RequestId long, ContractId long, Close double").withColumn("Timestamp", F.lit(T0))
    assert M.bars_of_request(bars, "X", request_id=10, contract_id=555).count() == 2 and M.bars_of_request(bars, "X", contract_id=555).count() == 3 and M.bars_of_request(bars, "X", request_id=99).count() == 0
    chain = spark.createDataFrame([(77, "CBOE", "A", "100", "20260320,20260213, bad,20260306,202604", "105,x, 95,100"), (77, "SMART", "A", "100", "20260213", "100")], "RequestId long, Exchange string, TradingClass string, Multiplier string, Expirations string, Strikes string")
    c = M.option_chain(chain, 77)
    first = c.where("Exchange = 'CBOE'").first()
    assert first["Expirations"] == [date(2026, 2, 13), date(2026, 3, 6), date(2026, 3, 20), date(2026, 4, 1)] and first["Strikes"] == [95.0, 100.0, 105.0]
    assert M.preferred_exchange(c).first()["Exchange"] == "SMART"
    days = c.where("Exchange = 'CBOE'").select("RequestId", F.explode("Expirations").alias("d"))
    assert M.nearest_expiry(days, "RequestId", "d", date(2026, 2, 1)).first()["expiry"] == date(2026, 3, 20)
    assert M.nearest_expiry(days, "RequestId", "d", date(2026, 3, 5)).first()["expiry"] == date(2026, 4, 1)
    assert M.nearest_expiry(days, "RequestId", "d", date(2026, 2, 28)).first()["expiry"] == date(2026, 3, 20)  # exactly 20 days
    assert M.nearest_expiry(days, "RequestId", "d", date(2027, 1, 1)).count() == 0
    spots, ladder = spark.createDataFrame([(1, 100.0), (2, 0.0)], "id long, spot double"), spark.createDataFrame([(i, k) for i in (1, 2) for k in (90.0, 97.5, 102.5, 110.0)], "id long, strike double")
    assert [(r["id"], r["strike"]) for r in M.atm_strikes(ladder, spots, "id", 2).orderBy("rank").collect()] == [(1, 97.5), (1, 102.5)]
    p = M.Pacer(rate=5)
    assert [p.acquire(0.0) for _ in range(3)] == pytest.approx([0.0, 0.2, 0.4]) and p.wait(10.0) == 0.0 and M.Pacer(rate=900).ceiling == 45


def test_strikes_of_ladders_and_an_exploded_ladder(spark):
    ladders = spark.createDataFrame([(1, 100.0, [110.0, 97.5, 90.0, 102.5]), (2, 0.0, [1.0]), (3, 5.0, []), (4, 6.0, [9.0]), (None, 1.0, [1.0])], "id long, spot double, strikes array<double>")
    assert {(r["id"], r["strike"], r["rank"]) for r in M.atm_strikes_of_ladders(ladders, "id", 2).collect()} == {(1, 97.5, 1), (1, 102.5, 2), (4, 9.0, 1), (None, 1.0, 1)}
    assert M.atm_strikes_of_ladders(ladders, "id", 0).count() == 0
    joined = M.atm_strikes(ladders.select("id", F.explode("strikes").alias("strike")), ladders.select("id", "spot"), "id", 2)
    assert {tuple(r) for r in joined.collect()} == {(1, 97.5, 1), (1, 102.5, 2), (4, 9.0, 1)}
    spots = spark.range(1000).selectExpr("id", "id % 90 + 1D AS spot")
    plan = M.atm_strikes(spots.select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("strike")), spots, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
