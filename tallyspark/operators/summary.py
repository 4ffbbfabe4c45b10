"""Single-account summaries: figures collected to dataclasses with dictionary and text forms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import PERIODS_PER_YEAR
from . import benchmark as B
from . import returns as R
from . import roundtrips


def _share(x: float) -> str:
    return f"{100 * x:+.2f}%" if x == x else "n/a"


def _plain(x: float, places: int = 2) -> str:
    return f"{x:.{places}f}" if x == x else "n/a"


def _lines(title: str, rows: list[tuple[str, str]], notes: list[str]) -> str:
    return "\n".join([title, *(f"  {name:<24}{value}" for name, value in rows), "", *(f"  {n}" for n in notes)])


@dataclass(frozen=True)
class PerformanceSummary:
    """Figures of one account; ratios are annualized, and NaN where they have no value."""

    account: str | None
    start: datetime
    end: datetime
    num_periods: int
    periods_per_year: int
    risk_free_annual: float
    flows_applied: bool
    net_external_flows: float
    starting_nav: float
    ending_nav: float
    best_period: float
    worst_period: float
    hit_rate: float
    max_drawdown: float
    cumulative_return: float
    annualized_volatility: float
    annualized_return: float
    calmar_ratio: float
    sortino_ratio: float
    sharpe_ratio: float

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"start": self.start.isoformat(), "end": self.end.isoformat()}

    def render(self) -> str:
        rows = [
            ("Account", self.account or "-"),
            ("From, to", f"{self.start:%Y-%m-%d}, {self.end:%Y-%m-%d}; {self.num_periods} returns"),
            ("NAV, first and last", f"{self.starting_nav:,.2f}, {self.ending_nav:,.2f}"),
            ("Net external flows", f"{self.net_external_flows:,.2f}" + ("" if self.flows_applied else " (returns not adjusted)")),
            ("Return", _share(self.cumulative_return)),
            ("Return a year", _share(self.annualized_return)),
            ("Volatility a year", _share(self.annualized_volatility)),
            ("Sharpe ratio", f"{_plain(self.sharpe_ratio)} (risk-free {100 * self.risk_free_annual:.2f}%, {self.periods_per_year} periods a year)"),
            ("Sortino ratio", _plain(self.sortino_ratio)),
            ("Calmar ratio", _plain(self.calmar_ratio)),
            ("Largest drawdown", _share(self.max_drawdown)),
            ("Share of gains", _share(self.hit_rate).lstrip("+")),
            ("Best, worst period", f"{_share(self.best_period)}, {_share(self.worst_period)}"),
        ]
        return _lines("Performance", rows, ["Sharpe: excess return for each unit of volatility. Sortino: the same, losses only.", "Calmar: yearly return over the largest drawdown, the worst fall from a peak."])


@dataclass(frozen=True)
class RelativeSummary:
    """Figures of one account against a benchmark."""

    start: date
    end: date
    benchmark_label: str
    num_periods: int
    dropped_periods: int
    beta: float
    correlation: float
    r_squared: float
    alpha_annualized: float
    information_ratio: float
    tracking_error: float
    down_capture: float
    up_capture: float
    benchmark_annualized_return: float
    portfolio_annualized_return: float
    periods_per_year: int
    risk_free_annual: float

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"start": self.start.isoformat(), "end": self.end.isoformat()}

    def render(self) -> str:
        dated = [] if self.start == date.min else [("From, to", f"{self.start}, {self.end}; {self.num_periods} returns, {self.dropped_periods} without partner")]
        rows = [
            *dated,
            ("Beta", _plain(self.beta, 3)),
            ("Alpha a year", _share(self.alpha_annualized)),
            ("Correlation, squared", f"{_plain(self.correlation, 3)}, {_plain(self.r_squared, 3)}"),
            ("Tracking error", _share(self.tracking_error)),
            ("Information ratio", _plain(self.information_ratio, 3)),
            ("Capture up, down", f"{_plain(self.up_capture, 3)}, {_plain(self.down_capture, 3)}"),
            ("Return, benchmark's", f"{_share(self.portfolio_annualized_return)}, {_share(self.benchmark_annualized_return)}"),
        ]
        title = "Relative performance" if self.benchmark_label == "<returns>" else f"Performance against {self.benchmark_label}"
        return _lines(title, rows, ["Beta: how far the benchmark's moves are followed. Alpha: return that beta doesn't explain.", "Tracking error: volatility of the difference. Capture: share of the benchmark's gains and losses."])


def only_account(df: DataFrame, account: str | None) -> DataFrame:
    """The rows of one account; the table as it is where it has none. ValueError for an unknown one, or for several without a name."""
    if "Account" not in df.columns:
        return df
    have = sorted(r[0] for r in df.select("Account").where("Account IS NOT NULL AND Account <> ''").distinct().limit(1000).collect())
    if account is not None:
        if account not in have and df.where(F.col("Account") == account).isEmpty():
            raise ValueError(f"there is no account {account!r}; there are {', '.join(have)}")
        return df.where(F.col("Account") == account)
    if len(have) > 1:
        raise ValueError(f"name one of the accounts {', '.join(have)}")
    return df


def _source(source: Any, account: str | None, adjust: bool, value_column: str) -> tuple[DataFrame, DataFrame | None]:
    """The NAV of one account, of a port, a result or a DataFrame, without null accounts told apart; and a port's flows, if they can be had."""
    flows = None
    if isinstance(source, DataFrame):
        nav = source
    elif hasattr(source, "frame"):
        nav = source.frame
    else:
        nav = source.table("nav").frame
        if adjust:
            try:
                cash = source.table("cash").frame
                flows = R.external_flows(cash.where(F.col("Account") == account) if account is not None and "Account" in cash.columns else cash).withColumn("Account", F.lit(None).cast("string"))
            except Exception:  # without a cash table, or with one that can't be read, returns are not adjusted
                flows = None
    return only_account(nav, account), flows


def performance_of(nav: DataFrame, flows: DataFrame | None = None, *, account: str | None = None, value_column: str = "Total", risk_free_annual: str | float | None = None, periods_per_year: int = PERIODS_PER_YEAR) -> PerformanceSummary:
    """One account's figures. ValueError with fewer than two NAV points, or where no period starts from a NAV other than 0."""
    nav = only_account(nav, account)
    name = nav.agg(F.min("Account")).first()[0] if "Account" in nav.columns else None
    single = nav.drop("Account")
    flows = None if flows is None else flows.groupBy("flow_date").agg(F.sum("amount").alias("amount")).withColumn("Account", F.lit(None).cast("string"))
    n = R.nav_points(single, value_column).count()
    if n < 2:
        raise ValueError(f"performance takes two NAV points at least, not {n}")
    found = R.performance(single, flows, value_column=value_column, risk_free_annual=risk_free_annual, periods_per_year=periods_per_year).collect()
    if not found:
        raise ValueError(f"there is no return: every period starts from a {value_column} of 0")
    return PerformanceSummary(**{k: v for k, v in found[0].asDict().items() if k != "Account"}, account=name)


def performance_summary(source: Any, *, account: str | None = None, adjust_for_flows: bool = True, flows: DataFrame | None = None, value_column: str = "Total", **how: Any) -> PerformanceSummary:
    """Figures of an account of a port, a result or a NAV DataFrame; a port's own deposits and withdrawals are taken out of returns."""
    nav, own = _source(source, account, adjust_for_flows, value_column)
    return performance_of(nav, flows if flows is not None else own, account=account, value_column=value_column, **how)


def sharpe_ratio(source: Any, **how: Any) -> float:
    return performance_summary(source, **how).sharpe_ratio


def statement_performance(spark: SparkSession, source: str | Path, *, account: str | None = None, base_currency: str | None = None, **how: Any) -> PerformanceSummary:
    """Figures of a statement. Its accounts are those of its NAV and of its cash: with several, one must be named."""
    from ..sources.statement import load

    tables = load(spark, source).tables
    both = tables["nav"].select("Account").unionByName(tables["cash"].select("Account"))
    only_account(both, account)
    pick = lambda df: df.where(F.col("Account") == account) if account is not None else df
    R.warn_of_skipped(pick(tables["cash"]), base_currency)
    return performance_of(pick(tables["nav"]), R.external_flows(pick(tables["cash"]), base_currency), **how)


def relative_summary(portfolio: Any, benchmark: DataFrame, *, account: str | None = None, adjust_for_flows: bool = True, benchmark_value_column: str = "Close", value_column: str = "Total", label: str | None = None, **how: Any) -> RelativeSummary:
    """An account against a benchmark of values by Timestamp. ValueError for repeated return dates or fewer than two that both have."""
    nav, flows = _source(portfolio, account, adjust_for_flows, value_column)
    p = R.daily_returns(nav.drop("Account"), flows, value_column)
    b = R.daily_returns(benchmark.drop("Account"), None, benchmark_value_column)
    for side, rows in (("portfolio", p), ("benchmark", b)):
        if not B.duplicate_dates(rows).isEmpty():
            raise ValueError(f"the {side} has several returns on one date")
    both = B.aligned(p, b)
    found = B.relative(both, **how).drop("Account").collect()
    if not found:
        raise ValueError("portfolio and benchmark have fewer than two returns in common")
    if label is None:
        label = benchmark.select("Sym").first()[0] if "Sym" in benchmark.columns else "<custom>"
    lost = p.count() + b.count() - 2 * found[0]["num_periods"]
    return RelativeSummary(benchmark_label=label, dropped_periods=lost, **found[0].asDict())


def relative_metrics(spark: SparkSession, portfolio_returns: Sequence[float], benchmark_returns: Sequence[float], **how: Any) -> RelativeSummary:
    """Two plain series of returns against each other, without dates; label and dates stay unset. ValueError for unequal lengths or fewer than two."""
    if len(portfolio_returns) != len(benchmark_returns):
        raise ValueError(f"the series have different lengths, {len(portfolio_returns)} and {len(benchmark_returns)}")
    pairs = [(float(p), float(b), date.min) for p, b in zip(portfolio_returns, benchmark_returns)]
    both = spark.createDataFrame(pairs, "p double, b double, later_date date").withColumn("Account", F.lit(None).cast("string"))
    found = B.relative(both, **how).drop("Account", "start", "end").collect()
    if not found:
        raise ValueError("the series have fewer than two returns")
    return RelativeSummary(start=date.min, end=date.min, benchmark_label="<returns>", dropped_periods=0, **found[0].asDict())


@dataclass(frozen=True)
class JournalResult:
    """Statistics over closed round trips, whole and by group, with what is still open beside them."""

    open_commission: float
    open_realized_pnl: float
    warnings: list[dict[str, str]]
    aggregates: dict[str, Any]
    round_trips: list[dict[str, Any]]
    by_group: dict[str, dict[str, Any]]
    open_round_trips: list[dict[str, Any]]

    def as_dict(self, /) -> dict[str, Any]:
        """All of it but the money of open trips."""
        return {k: v for k, v in asdict(self).items() if k not in ("open_realized_pnl", "open_commission")}

    def render(self) -> str:
        rows = [("All", self.aggregates), *self.by_group.items()]
        fmt = lambda x: "n/a" if x is None else f"{x:,.2f}"
        return _lines("Round trips", [(k, f"{s['count']} trips, won {fmt(s['win_rate'] and 100 * s['win_rate'])}%, P&L {fmt(s['total_realized_pnl'])}, net {fmt(s['total_net_pnl'])}, factor {fmt(s['profit_factor'])}") for k, s in rows], ["P&L is before commission, net after it; commission is negative where it cost."])


def journal_of(fills: DataFrame, /, group_by: str = "symbol") -> "JournalResult":
    """The journal of a set of fills that fits on the driver."""
    trips = roundtrips.round_trips(fills)
    by_group = roundtrips.journal(trips, group_by)
    rows = [r.asDict() for r in trips.orderBy("Sym", "trip").collect()]
    money = roundtrips.open_totals(trips).first()
    return JournalResult(
        aggregates=roundtrips.journal(trips, None).first().asDict(), by_group={r["group_key"]: {k: v for k, v in r.asDict().items() if k != "group_key"} for r in by_group.orderBy("group_key").collect()},
        warnings=[{"sym": r["Sym"], "reason": r["reason"]} for r in roundtrips.warnings(trips).orderBy("Sym").collect()], open_realized_pnl=money["open_realized_pnl"], open_commission=money["open_commission"],
            round_trips=[r for r in rows if not r["is_open"]], open_round_trips=[r for r in rows if r["is_open"]],
    )
