"""Canonical tables from raw event tables: declared views and their interpreter."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.core import SEQ, arrival, last_by, natural_join, pivot_latest
from ..types import CATALOG, DType, column

#: The vendor's mark for a number that isn't set, of either sign.
UNSET = 1.7976931348623157e308

_PNL = frozenset({"DailyPnl", "UnrealizedPnl", "RealizedPnl"})
SCRUBBED = {"position_pnl": _PNL | {"MarketValue"}, "account_pnl": _PNL}


@dataclass(frozen=True)
class View:
    """A canonical table read from raw ones. Raw columns keep their names where `names` doesn't give canonical ones."""

    table: str
    source: str
    names: Mapping[str, str]
    #: A second raw table, its key and the columns it gives: (table, own key, its key, columns).
    join: tuple[str, str, str, tuple[str, ...]] | None = None
    #: Current-state tables keep the last row for these canonical columns.
    keys: tuple[str, ...] = ()
    #: A text column that holds whole numbers.
    whole: str | None = None


def _names(spec: str) -> dict[str, str]:
    return dict(pair.split("=") if "=" in pair else (pair, pair) for pair in spec.split())


_CONTRACT = "ContractId=ConId Symbol=Sym SecType Currency Multiplier Right Strike LastTradeDateOrContractMonth LocalSymbol"

VIEWS: dict[str, View] = {
    v.table: v
    for v in (
        View("position", "accounts_positions", _names(f"{_CONTRACT} Account Position=Qty AvgCost Exchange"), keys=("Account", "ConId")),
        View("execution", "orders_exec_details", _names("ExecId Timestamp Account ContractId=ConId OrderId OrderRef Symbol=Sym SecType Side Shares=Qty Price Multiplier ExecutionExchange=Venue Currency Commission RealizedPNL=RealizedPnl"), join=("orders_exec_commission_report", "ExecId", "ExecId", ("Commission", "RealizedPNL"))),
        View("order", "orders_submitted", _names("OrderId PermId Account Symbol=Sym Action=Side TotalQuantity=Qty FilledQuantity=FilledQty LmtPrice=LimitPrice Status ReceiveTime=Timestamp")),
        View("definition", "contracts_details", _names(f"{_CONTRACT} PrimaryExchange=Exchange")),
        View("quote", "ticks_bid_ask", _names("Symbol=Sym Timestamp BidPrice=Bid AskPrice=Ask BidSize AskSize")),
        View("trade", "ticks_trade", _names("Symbol=Sym Timestamp Price Size")),
        View("bar", "bars_realtime", _names("Symbol=Sym Timestamp Open High Low Close Volume")),
        View("position_pnl", "accounts_pnl_single", _names("Account ConId DailyPnL=DailyPnl UnrealizedPnL=UnrealizedPnl RealizedPnL=RealizedPnl Value=MarketValue Symbol=Sym"), join=("accounts_positions", "ConId", "ContractId", ("Symbol",)), whole="ConId"),
        View("commission", "orders_exec_commission_report", _names("ExecId ReceiveTime=Timestamp Commission Currency RealizedPNL=RealizedPnl Yield YieldRedemptionDate"), keys=("ExecId",)),
        View("news", "news_historical", _names("Timestamp Symbol=Sym ContractId=ConId ProviderCode ArticleId Headline Name=ProviderName"), join=("news_providers", "ProviderCode", "Code", ("Name",))),
        View("errors", "errors", _names("ReceiveTime=Timestamp RequestId=ReqId ErrorCode=Code ErrorDescription=Message Error=Detail Note Tier=Severity Symbol=Sym ContractId=ConId")),
        View("account_pnl", "accounts_pnl", _names("Account ReceiveTime=Timestamp DailyPnl UnrealizedPnl RealizedPnl"), keys=("Account",)),
        View("price_tick", "ticks_price", _names("ReceiveTime=Timestamp ContractId=ConId Symbol=Sym TickType Price")),
        View("news_provider", "news_providers", _names("Code Name"), keys=("Code",)),
    )
}

#: Positions where only the portfolio table is filled.
PORTFOLIO = View("position", "accounts_portfolio", _names(f"{_CONTRACT} Account Position=Qty AvgCost Exchange MarketPrice MarketValue UnrealizedPnL=UnrealizedPnl"), keys=("Account", "ConId"))


def scrub(x: Column) -> Column:
    """Null for NaN and for the vendor's unset mark."""
    return F.when(~F.isnan(x) & (F.abs(x) < UNSET), x)


def to_double(x: Column, kind: T.DataType) -> Column:
    """Text parsed, empty or unreadable text as null, numbers widened; white space is not trimmed."""
    if isinstance(kind, T.StringType):
        return F.when(x.rlike(r"^\S(.*\S)?$"), x.try_cast("double"))
    return x.cast("double")


def side(x: Column) -> Column:
    return F.when(x == "BOT", "BUY").when(x == "SLD", "SELL").otherwise(x)


def apply_view(view: View, raw: Mapping[str, DataFrame]) -> DataFrame:
    """The canonical table, with its arrival numbers in _seq at the end."""
    schema, rows = CATALOG[view.table], arrival(raw[view.source])
    if view.whole:
        rows = rows.withColumn(view.whole, F.nullif(column(view.whole).cast("string"), F.lit("")).try_cast("bigint"))
    if view.join:
        other, own, its, bring = view.join
        if other in raw:
            rows = natural_join(rows, arrival(raw[other]), [(own, its)], bring)
    if view.table == "errors" and "Tier" not in rows.columns:
        from ..operators.diagnostics import DATA_WARNING, INFO, tier

        said = tier(F.col("ErrorCode"), F.coalesce(F.nullif(column("Error"), F.lit("")), column("ErrorDescription")) if "Error" in rows.columns else column("ErrorDescription"))
        rows = rows.withColumn("Tier", F.when(said == DATA_WARNING, INFO).otherwise(said))
    have = {f.name: f.dataType for f in rows.schema}
    canonical = {new: (column(old), have[old]) for old, new in view.names.items() if old in have}
    out = []
    for f in schema.fields:
        if f.name not in canonical:
            out.append(F.lit(None).cast(f.dtype.spark).alias(f.name))
            continue
        x, kind = canonical[f.name]
        if f.dtype is DType.FLOAT64:
            x = to_double(x, kind)
        if f.name == "Commission" and view.table in ("execution", "commission"):
            x = -x
        if f.name in SCRUBBED.get(view.table, ()):
            x = scrub(x)
        if f.name == "Side" and view.table == "execution":
            x = side(x)
        out.append(x.cast(f.dtype.spark).alias(f.name))
    table = rows.select(*out, SEQ)
    return last_by(table, view.keys) if view.keys else table


def with_marks(positions: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Positions with the price, value and P&L of the last portfolio row of the same account and contract, or nulls."""
    marks = arrival(portfolio).select("Account", "ContractId", "MarketPrice", "MarketValue", F.col("UnrealizedPnL").alias("UnrealizedPnl"), SEQ)
    joined = natural_join(positions, marks, [("Account", "Account"), ("ConId", "ContractId")], ["MarketPrice", "MarketValue", "UnrealizedPnl"])
    return joined.select(*positions.columns)


def positions(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Positions with marks; from the portfolio table where the positions table is missing or empty."""
    if "accounts_positions" in raw and not raw["accounts_positions"].isEmpty():
        table = apply_view(VIEWS["position"], raw)
        return with_marks(table, raw["accounts_portfolio"]) if "accounts_portfolio" in raw else table
    return apply_view(PORTFOLIO, raw)


_ACCOUNT_KEYS = _names("NetLiquidation BuyingPower MaintMarginReq=MaintMargin GrossPositionValue TotalCashValue")
_LEDGER_KEYS = {f"$LEDGER-{k}": v for k, v in _names("CashBalance NetLiquidationByCurrency=NetLiquidation ExchangeRate").items()}


def account(overview: DataFrame, only: str | None = None) -> DataFrame:
    """A row for each account that reports NetLiquidation, whose row gives Currency and Timestamp."""
    rows = arrival(overview)
    rows = rows.where(F.col("Account") == only) if only else rows
    return CATALOG["account"].project(pivot_latest(rows, ["Account"], "Key", "DoubleValue", _ACCOUNT_KEYS, "NetLiquidation", {"Currency": "Currency", "ReceiveTime": "Timestamp"}))


def cash_balance(overview: DataFrame, only: str | None = None) -> DataFrame:
    """A row for each account and currency, BASE included, that reports a ledger cash balance."""
    rows = arrival(overview).where("Currency IS NOT NULL")
    rows = rows.where(F.col("Account") == only) if only else rows
    return CATALOG["cash_balance"].project(pivot_latest(rows, ["Account", "Currency"], "Key", "DoubleValue", _LEDGER_KEYS, "$LEDGER-CashBalance"))


def account_snapshot(overview: DataFrame) -> DataFrame:
    """Each account's figures in USD if it reports any in it, else in its first currency; numbers come from Value where DoubleValue is null."""
    rows = arrival(overview).withColumn("v", F.coalesce("DoubleValue", F.expr("try_cast(Value AS double)"))).where(F.col("Key").isin(*_ACCOUNT_KEYS))
    best = rows.groupBy("Account").agg(F.coalesce(F.max(F.when(F.col("Currency") == "USD", "USD")), F.min_by("Currency", SEQ)).alias("best"))
    chosen = rows.join(best, "Account").where(F.col("Currency").eqNullSafe(F.col("best")))
    wanted = {k: n for k, n in _ACCOUNT_KEYS.items() if k != "TotalCashValue"}
    return pivot_latest(chosen, ["Account"], "Key", "v", wanted, "NetLiquidation", {"Currency": "Currency", "ReceiveTime": "Timestamp"})


def canonical(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every canonical table whose raw table is there."""
    out = {name: apply_view(v, raw) for name, v in VIEWS.items() if name != "position" and v.source in raw}
    if "accounts_positions" in raw or "accounts_portfolio" in raw:
        out["position"] = positions(raw)
    if "accounts_overview" in raw:
        out["account"], out["cash_balance"] = account(raw["accounts_overview"]), cash_balance(raw["accounts_overview"])
    return out


def pnl_snapshot(pnl: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per-position P&L with symbols (ConId, Sym) looked up; ids that are no numbers become null, the row stays."""
    view = View("position_pnl", "accounts_pnl_single", VIEWS["position_pnl"].names, whole="ConId")
    table = apply_view(view, {"accounts_pnl_single": pnl}).drop("Sym")
    return CATALOG["position_pnl"].project(natural_join(table, symbols.withColumn(SEQ, F.lit(0)), [("ConId", "ConId")], ["Sym"]))


def raw_rows(df: DataFrame, predicate: str | None = None, query: object | None = None) -> DataFrame:
    """The rows of a raw table that fulfil a predicate, which reaches the scan; all of them without one.

    Where the streaming query that feeds the table is given and has failed, there are none, and a warning says so.
    """
    from ..functions.expr import compile_predicate
    from ..streaming.changes import snapshot_or_empty
    from ..types import schema_of

    if query is not None:
        return snapshot_or_empty(query, lambda: raw_rows(df, predicate), df.schema)
    return df.where(compile_predicate(predicate, schema_of(df))) if predicate else df


def table_snapshot(name: str, raw: Mapping[str, DataFrame], only: str | None = None) -> DataFrame:
    """The declared columns of one canonical table, of one account if named; an empty table where its raw table is missing."""
    schema = CATALOG[name]
    made = canonical(raw)
    if name not in made:
        spark = next(iter(raw.values())).sparkSession
        return spark.createDataFrame([], schema.spark)
    out = schema.project(made[name])
    return out.where(F.col("Account") == only) if only and "Account" in schema.names else out
