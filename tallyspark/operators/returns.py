"""Flow-adjusted returns and what follows from them, for all accounts in one job.

Every step keeps the shuffle by account that the first one makes: period windows, sums and rolling frames stack on it.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import PERIODS_PER_YEAR, risk_free
from ..types import column

NAN = float("nan")
logger = logging.getLogger(__name__)
NEW_YORK = "America/New_York"


def nan() -> Column:
    return F.lit(NAN)


def nav_points(nav: DataFrame, value_column: str = "Total") -> DataFrame:
    """(Account, ts, value) of the rows of a NAV table that have both; a table without accounts has the account null."""
    for c in ("Timestamp", value_column):
        if c not in nav.columns:
            raise ValueError(f"the NAV table has no column {c}; it has {', '.join(nav.columns)}")
    account = column("Account") if "Account" in nav.columns else F.lit(None)
    out = nav.select(account.cast("string").alias("Account"), column("Timestamp").cast("timestamp").alias("ts"), column(value_column).cast("double").alias("value"))
    return out.where(F.col("ts").isNotNull() & F.col("value").isNotNull())


BASE_CURRENCY = "USD"


def _movements(cash: DataFrame, base_currency: str | None) -> DataFrame:
    """(Account, Type, Timestamp, Amount, Currency, flow_date, amount) of the deposits, withdrawals and transfers that have an amount and a time; amount, in base currency, is null where it can't be told."""
    get = lambda c, t: column(c).cast(t) if c in cash.columns else F.lit(None).cast(t)
    fx, own = get("FxRateToBase", "double"), F.upper(F.btrim(get("Currency", "string"), F.lit(" \t\r\n\f\x0b")))
    base = F.lit((base_currency or BASE_CURRENCY).strip().upper())
    rows = cash.where(F.lower(get("Type", "string")).rlike("deposit|withdraw|transfer")).select(
        get("Account", "string").alias("Account"), get("Type", "string").alias("Type"), get("Timestamp", "timestamp").alias("Timestamp"), get("Amount", "double").alias("Amount"), get("Currency", "string").alias("Currency"),
        F.when(fx > 0, get("Amount", "double") * fx).when(own.isNull() | (own == base), get("Amount", "double")).alias("amount_in_base"),
    )
    return rows.where("Timestamp IS NOT NULL AND Amount IS NOT NULL").withColumn("flow_date", F.to_date(F.from_utc_timestamp("Timestamp", NEW_YORK)))


def external_flows(cash: DataFrame, base_currency: str | None = None) -> DataFrame:
    """(Account, flow_date, amount): deposits, withdrawals and transfers by New York day, in base currency.

    Amounts with a positive FxRateToBase are converted; those without count as they are if their currency is null or the
    base currency, USD if none is named, in any case and with any white space around it; else they are left out, see skipped_flows(). A table without
    Type, Amount or Timestamp has no flows.
    """
    spark = cash.sparkSession
    if not {"Type", "Amount", "Timestamp"} <= set(cash.columns):
        return spark.createDataFrame([], "Account string, flow_date date, amount double")
    return _movements(cash, base_currency).where("amount_in_base IS NOT NULL").groupBy("Account", "flow_date").agg(F.sum("amount_in_base").alias("amount"))


def skipped_flows(cash: DataFrame, base_currency: str | None = None) -> DataFrame:
    """(Account, flow_date, Type, Amount, Currency) of the movements that external_flows() leaves out for want of an exchange rate."""
    if not {"Type", "Amount", "Timestamp"} <= set(cash.columns):
        return cash.sparkSession.createDataFrame([], "Account string, flow_date date, Type string, Amount double, Currency string")
    return _movements(cash, base_currency).where("amount_in_base IS NULL").select("Account", "flow_date", "Type", "Amount", "Currency")


def warn_of_skipped(cash: DataFrame, base_currency: str | None = None, named: int = 20) -> int:
    """Logs a warning for the first movements that are left out of returns, with how many there are; for single accounts, since they come to the driver."""
    skipped = skipped_flows(cash, base_currency)
    n = skipped.count()
    if n:
        for r in skipped.orderBy("flow_date").limit(named).collect():
            logger.warning("a %s of %s %s on %s is left out of the flows: there is no rate to convert it with, so that period's return counts it as gain", r["Type"], r["Amount"], r["Currency"], r["flow_date"])
        logger.warning("%d movements are left out of the flows", n)
    return n


def periods(nav: DataFrame, flows: DataFrame | None = None, value_column: str = "Total") -> DataFrame:
    """(Account, k, ts, value, flow, prior_ts, prior): each NAV point with the one before and the flows of its period.

    A flow belongs to the first point whose UTC date is its day or later, so to the half-open period (prior date, date]; flows before the first or after the last point
    belong to none. Points and flows are merged by one window on the account, which the next one uses too.
    """
    points = nav_points(nav, value_column).select("Account", "ts", "value", F.lit(None).cast("double").alias("amount"), F.to_date("ts").alias("day"), F.lit(1).alias("side"))
    if flows is not None:
        points = points.unionByName(flows.select("Account", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("value"), "amount", F.col("flow_date").alias("day"), F.lit(0).alias("side")))
    order = Window.partitionBy("Account").orderBy("day", "side", "ts", "value").rowsBetween(Window.unboundedPreceding, 0)
    merged = points.withColumn("k", F.sum("side").over(order) - F.col("side"))
    folded = merged.groupBy("Account", "k").agg(F.max("ts").alias("ts"), F.max("value").alias("value"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("flow")).where("ts IS NOT NULL")
    before = Window.partitionBy("Account").orderBy("k")
    return folded.select("*", F.lag("ts").over(before).alias("prior_ts"), F.lag("value").over(before).alias("prior"))


def daily_returns(nav: DataFrame, flows: DataFrame | None = None, value_column: str = "Total") -> DataFrame:
    """(Account, prior_date, later_date, Timestamp, r, flow): r = (value - prior - flow) / prior for each period whose prior value isn't 0."""
    p = periods(nav, flows, value_column).where("prior IS NOT NULL AND prior <> 0")
    return p.select("Account", F.to_date("prior_ts").alias("prior_date"), F.to_date("ts").alias("later_date"), F.col("ts").alias("Timestamp"), ((F.col("value") - F.col("prior") - F.col("flow")) / F.col("prior")).alias("r"), "flow", "k")


def _rooted(ppy: int) -> Column:
    return F.lit(math.sqrt(ppy))


def _spread(r: Column) -> Column:
    return F.coalesce(F.stddev_samp(r), nan())


def sharpe(r: Column, rf: float, ppy: int) -> Column:
    """Annualized mean excess over its sample deviation; NaN for fewer than two returns or none that differ."""
    return F.when(F.stddev_samp(r) > 0, (F.avg(r) - F.lit(rf / ppy)) / F.stddev_samp(r) * _rooted(ppy)).otherwise(nan())


def sortino(r: Column, rf: float, ppy: int) -> Column:
    excess = r - F.lit(rf / ppy)
    down = F.sqrt(F.avg(F.when(excess.isNotNull(), F.pow(F.least(excess, F.lit(0.0)), 2))))
    return F.when((F.count(r) >= 2) & (down > 0), F.avg(excess) / down * _rooted(ppy)).otherwise(nan())


def annualized_return(r: Column, ppy: int) -> Column:
    growth = F.product(1 + r)
    return F.when((F.count(r) >= 2) & (growth > 0), F.pow(growth, F.lit(float(ppy)) / F.count(r)) - 1).otherwise(nan())


def drawdown_curve(returns: DataFrame, by: Sequence[str] = ("Account",)) -> DataFrame:
    """returns with wealth, peak and drawdown so far; wealth starts at 1, which is the first peak."""
    so_far = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    w = returns.withColumn("wealth", F.product(1 + F.col("r")).over(so_far))
    w = w.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(so_far)))
    return w.withColumn("drawdown", F.least(F.col("wealth") / F.col("peak") - 1, F.lit(0.0)))


def performance(nav: DataFrame, flows: DataFrame | None = None, *, value_column: str = "Total", risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """One row of performance figures for each account with at least one return.

    Undefined ratios are NaN. net_external_flows sums the flows that entered a return.
    """
    rf, _ = risk_free(risk_free_annual)
    r, ppy = F.col("r"), periods_per_year
    usable = F.col("prior").isNotNull() & (F.col("prior") != 0)
    p = periods(nav, flows, value_column).withColumn("r", F.when(usable, (F.col("value") - F.col("prior") - F.col("flow")) / F.when(usable, F.col("prior"))))
    so_far = Window.partitionBy("Account").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # points without a return leave wealth as it is, so first and last points and all figures come from one pass
    p = p.withColumn("wealth", F.product(1 + F.coalesce(r, F.lit(0.0))).over(so_far))
    p = p.withColumn("drawdown", F.least(F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(so_far)) - 1, F.lit(0.0)))
    figures = p.groupBy("Account").agg(
        F.min_by("ts", "k").alias("start"),
        F.max_by("ts", "k").alias("end"),
        F.count("r").alias("num_periods"),
        F.min_by("value", "k").alias("starting_nav"),
        F.max_by("value", "k").alias("ending_nav"),
        F.sum(F.when(usable, F.col("flow"))).alias("net_external_flows"),
        (F.product(1 + r) - 1).alias("cumulative_return"),
        annualized_return(r, ppy).alias("annualized_return"),
        (_spread(r) * _rooted(ppy)).alias("annualized_volatility"),
        sharpe(r, rf, ppy).alias("sharpe_ratio"),
        sortino(r, rf, ppy).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hit_rate"),
        F.max("r").alias("best_period"),
        F.min("r").alias("worst_period"),
    ).where("num_periods > 0")
    calmar = F.when((F.col("max_drawdown") < 0) & ~F.isnan("annualized_return"), F.col("annualized_return") / F.abs("max_drawdown")).otherwise(nan())
    return figures.select(
        "Account", "start", "end", "num_periods", "starting_nav", "ending_nav", "net_external_flows", F.lit(flows is not None).alias("flows_applied"), "cumulative_return", "annualized_return", "annualized_volatility",
        "sharpe_ratio", "sortino_ratio", calmar.alias("calmar_ratio"), "max_drawdown", "hit_rate", "best_period", "worst_period", F.lit(rf).alias("risk_free_annual"), F.lit(ppy).alias("periods_per_year"),
    )


def _trailing(by: Sequence[str], window: int) -> Window:
    return Window.partitionBy(*by).orderBy("k").rowsBetween(-(window - 1), 0)


def rolling_performance(nav: DataFrame, flows: DataFrame | None = None, *, window: int = 63, value_column: str = "Total", risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """(Account, Timestamp, Return, Volatility, Sharpe, MaxDrawdown) over the last `window` returns, from the first full window on.

    A window's drawdown starts from wealth 1 at its own beginning.
    """
    if window < 2:
        raise ValueError(f"a window takes two returns at least, not {window}")
    rf, _ = risk_free(risk_free_annual)
    r, w = F.col("r"), _trailing(["Account"], window)
    sd, ppy = F.stddev_samp(r).over(w), periods_per_year
    step = lambda s, x: F.struct((s["wealth"] * (1 + x)).alias("wealth"), F.greatest(s["peak"], s["wealth"] * (1 + x)).alias("peak"), F.least(s["worst"], s["wealth"] * (1 + x) / F.greatest(s["peak"], s["wealth"] * (1 + x)) - 1).alias("worst"))
    start = F.struct(F.lit(1.0).alias("wealth"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))
    all_rows = daily_returns(nav, flows, value_column).select(
        "Account", "Timestamp", F.row_number().over(Window.partitionBy("Account").orderBy("k")).alias("n"), (F.product(1 + r).over(w) - 1).alias("Return"), (sd * _rooted(ppy)).alias("Volatility"),
        F.when(sd > 0, (F.avg(r).over(w) - F.lit(rf / ppy)) / sd * _rooted(ppy)).otherwise(nan()).alias("Sharpe"), F.collect_list("r").over(w).alias("rs"),
    )
    full = all_rows.where(F.col("n") >= window)
    return full.select(*full.columns[:2], *full.columns[3:6], F.aggregate("rs", start, step)["worst"].alias("MaxDrawdown"))


def period_key(ts: Column, freq: str) -> Column:
    keys = {"monthly": F.date_format(ts, "yyyy-MM"), "quarterly": F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string")), "yearly": F.date_format(ts, "yyyy")}
    if freq not in keys:
        raise ValueError(f"{freq!r} is no frequency: {', '.join(keys)}")
    return keys[freq]


def periodic_returns(nav: DataFrame, flows: DataFrame | None = None, *, freq: str = "monthly", value_column: str = "Total", risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """(Account, Period, Start, End, Return, Volatility, Sharpe) of each calendar month, quarter or year, a return counting where it ends."""
    rf, _ = risk_free(risk_free_annual)
    r, ppy = F.col("r"), periods_per_year
    rows = daily_returns(nav, flows, value_column).withColumn("Period", period_key(F.col("Timestamp"), freq))
    return rows.groupBy("Account", "Period").agg(F.min("Timestamp").alias("Start"), F.max("Timestamp").alias("End"), (F.product(1 + r) - 1).alias("Return"), (_spread(r) * _rooted(ppy)).alias("Volatility"), sharpe(r, rf, ppy).alias("Sharpe"))
