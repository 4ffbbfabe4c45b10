"""Portfolio returns against a benchmark's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import PERIODS_PER_YEAR, risk_free
from .returns import annualized_return, nan


def aligned(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(Account, prior_date, later_date, p, b, k): portfolio returns with the benchmark's return over exactly the same days.

    benchmark is a single series of (prior_date, later_date, r); it is joined by both dates, so returns that span a gap on
    one side only have no partner.
    """
    b = benchmark.select("prior_date", "later_date", F.col("r").alias("b"))
    return portfolio.select("Account", "prior_date", "later_date", F.col("r").alias("p"), "k").join(b, ["prior_date", "later_date"])


def duplicate_dates(returns: DataFrame, by: tuple[str, ...] = ("Account",)) -> DataFrame:
    """Return dates that a series has more than once; alignment by date has no meaning there."""
    return returns.groupBy(*by, "later_date").count().where("count > 1")


def _captured(p: Column, b: Column, up: bool, n: object = None) -> Column:
    side = b > 0 if up else b < 0
    own, its = F.product(F.when(side, 1 + p)) - 1, F.product(F.when(side, 1 + b)) - 1
    return F.when(its.isNull() | (its == 0), nan()).otherwise(own / its)


def relative(both: DataFrame, *, risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """One row of benchmark-relative figures for each account with two aligned returns or more; beta and alpha are of excess returns."""
    rf, _ = risk_free(risk_free_annual)
    p, b, ppy = F.col("p"), F.col("b"), periods_per_year
    active, root = p - b, math.sqrt(ppy)
    base = both.groupBy("Account").agg(
        F.count("*").alias("num_periods"), F.min("later_date").alias("start"), F.max("later_date").alias("end"), F.covar_samp("p", "b").alias("cov"), F.var_samp("b").alias("vb"), F.stddev_samp("p").alias("sp"), F.stddev_samp("b").alias("sb"), F.avg("p").alias("mp"), F.avg("b").alias("mb"),
        F.stddev_samp(active).alias("ta"), F.avg(active).alias("ma"), _captured(p, b, True).alias("up_capture"), _captured(p, b, False).alias("down_capture"), annualized_return(p, ppy).alias("portfolio_annualized_return"), annualized_return(b, ppy).alias("benchmark_annualized_return"),
    ).where("num_periods >= 2")
    each = rf / ppy
    beta = F.when(F.col("vb") > 0, F.col("cov") / F.col("vb")).otherwise(nan())
    correlation = F.when((F.col("sp") > 0) & (F.col("sb") > 0), F.col("cov") / (F.col("sp") * F.col("sb"))).otherwise(nan())
    return base.select(
        "Account", "num_periods", "start", "end", beta.alias("beta"), (((F.col("mp") - each) - beta * (F.col("mb") - each)) * ppy).alias("alpha_annualized"), correlation.alias("correlation"), (correlation * correlation).alias("r_squared"), (F.coalesce("ta", nan()) * root).alias("tracking_error"),
        F.when(F.col("ta") > 0, F.col("ma") / F.col("ta") * root).otherwise(nan()).alias("information_ratio"), "up_capture", "down_capture", "portfolio_annualized_return", "benchmark_annualized_return", F.lit(rf).alias("risk_free_annual"), F.lit(ppy).alias("periods_per_year"),
    )


def dropped(portfolio: DataFrame, benchmark: DataFrame, both: DataFrame) -> DataFrame:
    """(Account, dropped_periods): returns of either side without a partner."""
    n_b = benchmark.agg(F.count("*").alias("nb"))
    counts = portfolio.groupBy("Account").agg(F.count("*").alias("n")).alias("c")
    common = both.groupBy(F.col("Account").alias("a")).agg(F.count("*").alias("nc"))
    joined = counts.join(common, F.col("Account").eqNullSafe(F.col("a")), "left").crossJoin(n_b)
    return joined.select("Account", (F.col("n") + F.col("nb") - 2 * F.coalesce("nc", F.lit(0))).alias("dropped_periods"))


def rolling_relative(both: DataFrame, *, window: int = 63, risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """(Account, Timestamp, Beta, Alpha, Correlation, TrackingError) over the last `window` aligned returns, from the first full window on; Timestamp is the last day's start in UTC."""
    if window < 2:
        raise ValueError(f"a window takes two returns at least, not {window}")
    rf, _ = risk_free(risk_free_annual)
    w = Window.partitionBy("Account").orderBy("later_date").rowsBetween(-(window - 1), 0)
    p, b, ppy = F.col("p"), F.col("b"), periods_per_year
    cov, vb, sp, sb = F.covar_samp(p, b).over(w), F.var_samp(b).over(w), F.stddev_samp(p).over(w), F.stddev_samp(b).over(w)
    rows = both.select("Account", "later_date", F.row_number().over(Window.partitionBy("Account").orderBy("later_date")).alias("n"), cov.alias("cov"), vb.alias("vb"), sp.alias("sp"), sb.alias("sb"), F.avg(p).over(w).alias("mp"), F.avg(b).over(w).alias("mb"), F.stddev_samp(p - b).over(w).alias("ta"))
    beta = F.when(F.col("vb") > 0, F.col("cov") / F.col("vb")).otherwise(nan())
    each = rf / ppy
    return rows.where(F.col("n") >= window).select(
        "Account", F.col("later_date").cast("timestamp").alias("Timestamp"), beta.alias("Beta"), (((F.col("mp") - each) - beta * (F.col("mb") - each)) * ppy).alias("Alpha"),
        F.when((F.col("sp") > 0) & (F.col("sb") > 0), F.col("cov") / (F.col("sp") * F.col("sb"))).otherwise(nan()).alias("Correlation"), (F.col("ta") * math.sqrt(ppy)).alias("TrackingError"),
    )
