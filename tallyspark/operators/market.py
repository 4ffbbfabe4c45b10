"""Market data and option chains, for all contracts and requests at once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import CATALOG
from .core import SEQ, arrival

MIN_DTE = 20


def _latest(value: str, *kinds: str) -> Column:
    """The last value that isn't null among ticks of these kinds, delayed ones counting like live ones."""
    named = [*kinds, *(f"DELAYED_{k}" for k in kinds)]
    return F.max_by(value, F.when(F.col("TickType").isin(*named) & F.col(value).isNotNull(), F.col(SEQ)))


def quote_snapshot(prices: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(ContractId, last, bid, ask, bid_size, ask_size, last_size, timestamp) of each contract with price ticks; timestamp is its last price tick's."""
    p = arrival(prices).groupBy("ContractId").agg(_latest("Price", "LAST").alias("last"), _latest("Price", "BID").alias("bid"), _latest("Price", "ASK").alias("ask"), F.max_by("ReceiveTime", SEQ).alias("timestamp"))
    if sizes is None:
        return p.select("ContractId", "last", "bid", "ask", *[F.lit(None).cast("double").alias(c) for c in ("bid_size", "ask_size", "last_size")], "timestamp")
    s = arrival(sizes).groupBy("ContractId").agg(_latest("Size", "BID_SIZE").alias("bid_size"), _latest("Size", "ASK_SIZE").alias("ask_size"), _latest("Size", "LAST_SIZE").alias("last_size"))
    return p.join(s, "ContractId", "left").select(*p.columns[:-1], *s.columns[1:], "timestamp")


def quotes_of(requests: DataFrame, prices: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """A row for each request (Symbol, ContractId): its quote_snapshot(), or what is wrong: error and message, else null.

    error is symbol_not_found where the contract is null, quote_timeout where the contract has no price tick.
    """
    found = quote_snapshot(prices, sizes).withColumn("ticked", F.lit(True))
    error = F.when(F.col("ContractId").isNull(), "symbol_not_found").when(F.col("ticked").isNull(), "quote_timeout")
    message = F.when(error == "symbol_not_found", "the symbol has no contract").when(error == "quote_timeout", "no market data: the market is closed, or it isn't subscribed to")
    return requests.select("Symbol", "ContractId").join(found, "ContractId", "left").select("Symbol", "ContractId", *[c for c in found.columns if c not in ("ContractId", "ticked")], error.alias("error"), message.alias("message"))


def last_rows(rows: DataFrame, by: str, n: int = 30) -> DataFrame:
    """The last n rows of each group in order of arrival; n of 0 or less means 30."""
    w = Window.partitionBy(by).orderBy(F.desc(SEQ))
    ranked = arrival(rows).withColumn("__rank", F.row_number().over(w))
    return ranked.where(F.col("__rank") <= (n if n > 0 else 30)).drop("__rank")


def bars_of_request(bars: DataFrame, sym: str, request_id: int | None = None, contract_id: int | None = None) -> DataFrame:
    """Canonical bars of one request, of its contract if one is named; without a request, of the contract; else all."""
    rows = bars
    if request_id is not None:
        rows = rows.where(F.col("RequestId") == request_id)
    if contract_id is not None:
        rows = rows.where(F.col("ContractId") == contract_id)
    return CATALOG["bar"].project(rows.withColumn("Sym", F.lit(sym)))


def bars_of_requests(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Canonical bars of many requests (RequestId, Sym), in one pass; requests without bars have none."""
    return CATALOG["bar"].project(bars.drop("Sym").join(requests.select("RequestId", "Sym"), "RequestId"))


def bar_tables(bars: DataFrame, request_ids: dict[str, int], query: object | None = None) -> dict[str, DataFrame]:
    """{symbol: its canonical bars}, for every symbol of {symbol: request id}; one without bars has an empty table, and so have all where the query that feeds the bars has failed."""
    from ..plans.views import raw_rows

    rows = raw_rows(bars, query=query).where(F.col("RequestId").isin(*request_ids.values())) if request_ids else bars
    return {symbol: bars_of_request(rows, symbol, request) for symbol, request in request_ids.items()}


def parse_expiry(text: Column) -> Column:
    """A date from YYYYMMDD, or from YYYYMM its first day; null for anything else."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(bare, F.lit("yyyyMMdd")))).when(bare.rlike(r"^\d{6}$"), F.to_date(F.try_to_timestamp(F.concat(bare, F.lit("01")), F.lit("yyyyMMdd"))))


def expirations(text: Column) -> Column:
    """The sorted dates of a comma-separated list, what is no date left out."""
    return F.array_sort(F.filter(F.transform(F.split(text, ","), parse_expiry), lambda d: d.isNotNull()))


def strikes(text: Column) -> Column:
    """The sorted numbers of a comma-separated list, what is no number left out."""
    return F.array_sort(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda k: k.isNotNull()))


def option_chain(params: DataFrame, request_id: int | None = None) -> DataFrame:
    """Parameters of each exchange, (RequestId, Exchange, TradingClass, Multiplier, Expirations, Strikes), the lists parsed."""
    rows = params if request_id is None else params.where(F.col("RequestId") == request_id)
    return rows.select("RequestId", "Exchange", "TradingClass", "Multiplier", expirations(F.col("Expirations")).alias("Expirations"), strikes(F.col("Strikes")).alias("Strikes"))


def preferred_exchange(chain: DataFrame, exchange: str = "SMART") -> DataFrame:
    """Of each request's exchanges the preferred one, or else the first by name."""
    w = Window.partitionBy("RequestId").orderBy(F.desc(F.col("Exchange") == exchange), "Exchange", "TradingClass")
    return chain.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "FRI"), 14)


def nearest_expiry(chain: DataFrame, by: str, expiry: str, today: Column | date, min_dte: int = MIN_DTE, monthly_only: bool = False) -> DataFrame:
    """(by, expiry): of each group's dates the nearest at least min_dte days after today, a third Friday before any other. Groups without one have no row."""
    now = F.lit(today) if isinstance(today, date) else today
    monthly = F.col(expiry) == third_friday(F.col(expiry))
    rows = chain.where(F.datediff(F.col(expiry), now) >= min_dte).select(by, F.col(expiry).alias("d"), (~monthly).alias("other"))
    rows = rows.where("NOT other") if monthly_only else rows
    return rows.groupBy(by).agg(F.min(F.struct("other", "d"))["d"].alias("expiry"))


def _closest(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, strike, rank) of the k least apart of each group of (by, strike, apart)."""
    w = Window.partitionBy(by).orderBy("apart", "strike")
    return rows.select(by, "strike", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def atm_strikes(strikes_of: DataFrame, spots: DataFrame, by: str, k: int = 1) -> DataFrame:
    """(by, strike, rank): the k strikes closest to each group's positive spot, the lower of equally close ones first.

    strikes_of has (by, strike), spots (by, spot). They are merged, not broadcast: strikes that were exploded seem to Spark as small as what they
    came from.
    """
    rows = strikes_of.join(spots.where("spot > 0").hint("merge"), by)
    return _closest(rows.select(by, "strike", F.abs(F.col("strike") - F.col("spot")).alias("apart")), by, k)


def atm_strikes_of_ladders(ladders: DataFrame, by: str, k: int = 1) -> DataFrame:
    """atm_strikes() of rows (by, spot, strikes), the strikes an array as in option_chain(): no join, and only the k closest of a row are moved."""
    apart = F.transform("strikes", lambda s: F.struct(F.abs(s - F.col("spot")).alias("apart"), s.alias("strike")))
    return _closest(ladders.where("spot > 0").select(by, F.inline(F.slice(F.sort_array(apart), 1, max(k, 0)))), by, k)


def latest_greeks(greeks: DataFrame) -> DataFrame:
    """The row of each contract that arrived last."""
    from .core import last_by

    return last_by(arrival(greeks), ["ContractId"])


@dataclass
class Pacer:
    """Spaces requests to a source of limited rate: `rate` a second, and never more than `ceiling`."""

    rate: float = 5.0
    ceiling: float = 45.0
    due: float | None = None

    def acquire(self, now: float, /) -> float:
        """When the next request may go, at the earliest; the one after it waits its interval from then."""
        at = now if self.due is None else max(now, self.due)
        self.due = at + 1.0 / min(self.rate, self.ceiling)
        return at

    def wait(self, now: float) -> float:
        return max(0.0, self.acquire(now) - now)
