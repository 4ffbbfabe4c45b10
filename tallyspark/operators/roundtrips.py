"""Round trips: position cycles from flat to flat, reconstructed from fills by windows, and their statistics.

Fills (Sym, Side, Qty, Price, Timestamp, RealizedPnl, Commission, Multiplier, Strategy, _seq) run in the order of (Timestamp, _seq) within
a symbol. A running sum gives the position; a fill that goes through zero counts as two legs, one that closes and one
that opens; a running count of opening legs numbers the trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import SEQ, arrival

EPS = 1e-9


def fills_of(executions: DataFrame) -> DataFrame:
    """Fills from canonical executions: missing money is 0, a missing or zero multiplier 1, a missing order reference "unattributed"."""
    rows = arrival(executions)
    return rows.select(
        *"Sym Side Qty Price Timestamp".split(), F.coalesce("RealizedPnl", F.lit(0.0)).alias("RealizedPnl"), F.coalesce("Commission", F.lit(0.0)).alias("Commission"),
        F.when(F.coalesce("Multiplier", F.lit(0.0)) == 0, 1.0).otherwise(F.col("Multiplier")).alias("Multiplier"), F.coalesce("OrderRef", F.lit("unattributed")).alias("Strategy"), SEQ, *(["Account"] if "Account" in rows.columns else []),
    )


def round_trips(fills: DataFrame, by: Sequence[str] = ("Sym",)) -> DataFrame:
    """One row for each round trip, closed or still open.

    (by..., trip, direction, entry_ts, exit_ts, hold_seconds, qty, avg_entry_price, avg_exit_price, realized_pnl, commission,
    return_pct, strategy, is_open, suspect). A flip splits its commission by quantity and gives all its P&L to the trip it closes. Strategy and multiplier
    are those of the opening fill. suspect marks trips that end at or after a fill of the symbol that opens or adds to a position and
    realizes P&L all the same; the opening leg of a flip is not held to that. Any side but BUY sells.
    """
    w = Window.partitionBy(*by).orderBy("Timestamp", SEQ)
    signed = F.when(F.upper("Side") == "BUY", F.col("Qty")).otherwise(-F.col("Qty"))
    rows = fills.withColumn("s", signed).withColumn("pos", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev", F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    flat, along = F.abs("prev") < EPS, (F.col("prev") > 0) == (F.col("s") > 0)
    flip = ~flat & ~along & (F.col("Qty") > F.abs("prev") + EPS)
    rows = rows.withColumn("bad", (flat | along) & (F.abs("RealizedPnl") > EPS))

    def leg(qty: Column, entry: Column, opens: Column, pnl: Column, share: Column, closes: Column) -> Column:
        return F.struct(qty.alias("qty"), entry.alias("entry"), opens.alias("opens"), pnl.alias("pnl"), (F.col("Commission") * share).alias("fee"), closes.alias("closes"))

    true, false, one, zero = F.lit(True), F.lit(False), F.lit(1.0), F.lit(0.0)
    whole = leg(F.col("Qty"), flat | along, flat, F.when(flat | along, 0.0).otherwise(F.col("RealizedPnl")), one, ~flat & ~along & (F.abs("pos") < EPS))
    part = F.abs("prev") / F.col("Qty")
    legs = F.when(flip, F.array(leg(F.abs("prev"), false, false, F.col("RealizedPnl"), part, true), leg(F.col("Qty") - F.abs("prev"), true, true, zero, one - part, false))).otherwise(F.array(whole))
    split = rows.select(*by, "Timestamp", SEQ, "Price", "Multiplier", "Strategy", "s", "bad", F.posexplode(legs).alias("leg", "l"))
    split = split.select(*by, "Timestamp", SEQ, "leg", "Price", "Multiplier", "Strategy", "s", F.col("bad").cast("int").alias("bad"), "l.*")
    run = Window.partitionBy(*by).orderBy("Timestamp", SEQ, "leg").rowsBetween(Window.unboundedPreceding, 0)
    numbered = split.withColumn("trip", F.sum(F.col("opens").cast("int")).over(run)).withColumn("suspect", F.max("bad").over(run)).withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("Timestamp", SEQ, "leg")))
    # a trip's strategy and direction are known at its first leg; as keys they leave only fixed-width values to aggregate, so hashing does
    first = F.last(F.when(F.col("opens"), F.struct("Strategy", (F.col("s") > 0).alias("long"))), ignorenulls=True).over(run)
    numbered = numbered.withColumn("first", first).select("*", F.col("first.Strategy").alias("strategy_of"), F.col("first.long").alias("is_long"))
    opened = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    entry, out = F.col("entry"), ~F.col("entry")
    trips = numbered.groupBy(*by, "trip", "strategy_of", "is_long").agg(
        opened("Timestamp").alias("entry_ts"), F.max(F.when(F.col("closes"), F.col("Timestamp"))).alias("exit_ts"),
        F.sum(F.when(entry, F.col("qty")).otherwise(0.0)).alias("qty"), F.sum(F.when(entry, F.col("qty") * F.col("Price")).otherwise(0.0)).alias("bought"), F.sum(F.when(out, F.col("qty"))).alias("out"), F.sum(F.when(out, F.col("qty") * F.col("Price"))).alias("sold"),
        F.sum("pnl").alias("realized_pnl"), F.sum("fee").alias("commission"), opened("Multiplier").alias("multiplier"), (~F.max("closes")).alias("is_open"), (F.max_by("suspect", "at") == 1).alias("suspect"),
    )
    entry_price = F.when(F.col("qty") != 0, F.col("bought") / F.col("qty")).otherwise(0.0)
    worth = F.col("qty") * entry_price * F.col("multiplier")
    return trips.select(
        *by, "trip", F.when(F.col("is_long"), "long").otherwise("short").alias("direction"), "entry_ts", "exit_ts", F.when(~F.col("is_open"), (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 1e6).alias("hold_seconds"), "qty", entry_price.alias("avg_entry_price"), (F.col("sold") / F.col("out")).alias("avg_exit_price"), "realized_pnl", "commission",
        F.when(~F.col("is_open") & (worth != 0), F.col("realized_pnl") / F.when(worth != 0, worth)).alias("return_pct"), F.col("strategy_of").alias("strategy"), "is_open", "suspect",
    )


def warnings(trips: DataFrame, by: Sequence[str] = ("Sym",)) -> DataFrame:
    """(by..., reason): symbols with a suspect trip."""
    return trips.where("suspect").select(*by, F.lit("unmatched_close").alias("reason")).distinct()


def _stats() -> list[Column]:
    out: list[Column] = [F.count("*").alias("count")]
    for prefix, total, pnl in (("", "total_realized_pnl", F.col("realized_pnl")), ("net_", "total_net_pnl", F.col("realized_pnl") + F.col("commission"))):
        wins, losses = F.count_if(pnl > 0), F.count_if(pnl < 0)
        won, lost = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, pnl))
        out += [wins.alias(f"{prefix}wins"), losses.alias(f"{prefix}losses"), F.try_divide(wins.cast("double"), F.count("*")).alias(f"{prefix}win_rate"), F.avg(F.when(pnl > 0, pnl)).alias(f"{prefix}avg_win"), F.avg(F.when(pnl < 0, pnl)).alias(f"{prefix}avg_loss")]
        out += [(F.coalesce(won, F.lit(0.0)) / F.abs(lost)).alias(f"{prefix}profit_factor"), F.avg(pnl).alias(f"{prefix}expectancy"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias(total)]
    pnl = F.col("realized_pnl")
    return [*out, F.coalesce(F.sum("commission"), F.lit(0.0)).alias("total_commission"), F.avg("hold_seconds").alias("avg_hold_seconds"), F.max(F.when(pnl > 0, pnl)).alias("largest_win"), F.min(F.when(pnl < 0, pnl)).alias("largest_loss")]


def journal(trips: DataFrame, group_by: str | None = "symbol") -> DataFrame:
    """Statistics of closed trips for each symbol or strategy as group_key, or, with None, of all of them in one row.

    Figures come gross and, prefixed, net of commission. A trip without P&L neither won nor lost. What has no value, such as the mean of no wins, is null.
    """
    keys = {"symbol": "Sym", "strategy": "strategy", None: None}
    if group_by not in keys:
        raise ValueError(f"trips are grouped by symbol or strategy, not {group_by!r}")
    closed = trips.where("NOT is_open")
    return closed.agg(*_stats()) if group_by is None else closed.groupBy(F.col(keys[group_by]).alias("group_key")).agg(*_stats())


def open_totals(trips: DataFrame) -> DataFrame:
    """(open_trips, open_realized_pnl, open_commission): what trips that are still open have booked already."""
    return trips.where("is_open").agg(F.count("*").alias("open_trips"), F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("open_realized_pnl"), F.coalesce(F.sum("commission"), F.lit(0.0)).alias("open_commission"))
