"""Severity of vendor messages, data-farm states, and connection health, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import SEQ, arrival

GENUINE, DEGRADED, INFO, DATA_WARNING = "GENUINE_ERROR", "CONNECTIVITY_DEGRADED", "INFORMATIONAL", "MARKET_DATA_WARNING"
LOST, RESTORED = 1100, (1101, 1102)
BROKEN = (LOST, 2103, 2105, 2110, 2157)
DELAYED = (10091, 10167)
DENIED = (10089, 10168, 10197)

_FARM = r"(?i)^(market data|historical data|hmds data|sec-def data) farm connection is ([^:.]+)(?:[.:](\S+))?"


def tier(code: Column, message: Column) -> Column:
    """The tier of a message: certain codes first, then those from 2100 to 2169 by what their text says."""
    says_so = F.coalesce(message.rlike(r"(?i)\b(broken|lost)\b"), F.lit(False))
    return (
        F.when(code.isin(*BROKEN), DEGRADED)
        .when(code.isin(*RESTORED, 2176), INFO)
        .when(code.between(2100, 2169), F.when(says_so, DEGRADED).otherwise(INFO))
        .when(code.isin(*DELAYED), DATA_WARNING)
        .otherwise(GENUINE)
    )


def is_fatal(code: Column, message: Column) -> Column:
    return tier(code, message) == GENUINE


def is_denied(code: Column) -> Column:
    """Market data were refused; asking again won't help."""
    return code.isin(*DENIED)


def is_connectivity(code: Column) -> Column:
    return code.isin(*BROKEN, *RESTORED)


def is_lost(code: Column) -> Column:
    return code == LOST


def is_restored(code: Column) -> Column:
    return code.isin(*RESTORED)


def farm(message: Column) -> Column:
    """A struct (farm, kind, is_ok) for messages on data farms, else null; farm is null where none is named."""
    text = F.trim(message)
    kind, state, name = (F.regexp_extract(text, _FARM, k) for k in (1, 2, 3))
    ok = ~state.rlike(r"(?i)\b(lost|inactive|broken|not available)\b")
    sort = F.when(F.lower(kind).isin("historical data", "hmds data"), "historical_data").otherwise("market_data")
    return F.when(text.rlike(_FARM), F.struct(F.nullif(name, F.lit("")).alias("farm"), sort.alias("kind"), ok.alias("is_ok")))


def _read(errors: DataFrame) -> DataFrame:
    rows = arrival(errors)
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    message = F.coalesce(F.nullif(get("Error"), F.lit("")), F.nullif(get("ErrorDescription"), F.lit("")), F.lit(""))
    read = rows.select(F.expr("try_cast(ErrorCode AS int)").alias("code"), message.alias("message"), F.coalesce(F.nullif(get("ErrorDescription"), F.lit("")), message).alias("description"), SEQ)
    return read.where("code IS NOT NULL")


def diagnose(errors: DataFrame) -> DataFrame:
    """(code, message, description, tier, fatal, denied, connectivity, lost, restored, farm, _seq) of every raw message whose code is a number."""
    code, message = F.col("code"), F.col("message")
    return _read(errors).select(
        "code", "message", "description", tier(code, message).alias("tier"), is_fatal(code, message).alias("fatal"), is_denied(code).alias("denied"), is_connectivity(code).alias("connectivity"), is_lost(code).alias("lost"), is_restored(code).alias("restored"), farm(message).alias("farm"), SEQ
    )


def tier_counts(errors: DataFrame) -> DataFrame:
    return diagnose(errors).groupBy("tier").agg(F.count("*").alias("n"))


def genuine_errors(errors: DataFrame) -> DataFrame:
    return diagnose(errors).where("fatal").select("code", "description", SEQ)


def farms(errors: DataFrame) -> DataFrame:
    """(farm, is_ok): the latest state of each named farm."""
    return diagnose(errors).where("farm.farm IS NOT NULL").groupBy(F.col("farm.farm").alias("farm")).agg(F.max_by("farm.is_ok", SEQ).alias("is_ok"))


def connection_health(errors: DataFrame, connected: bool = True) -> DataFrame:
    """One row: connected, tier_counts, genuine_errors in order of arrival, farms, connection_lost, summary.

    The connection is lost if the last loss was not followed by a restore. Without messages all is empty and well. The row holds every genuine error; where they are
    too many for one row, genuine_errors() has them as a table.
    """
    d, by = diagnose(errors), F.col("farm.farm")
    turn = F.when(F.col("lost") | F.col("restored"), F.col(SEQ))
    # one pass: a few rows for each tier and farm first, then one of them all
    parts = d.groupBy("tier", by.alias("of_farm")).agg(
        F.count("*").alias("n"), F.max(SEQ).alias("at"), F.max_by("farm.is_ok", SEQ).alias("is_ok"), F.max(turn).alias("turned"), F.max_by("lost", turn).alias("lost"),
        F.collect_list(F.when(F.col("fatal"), F.struct(SEQ, "code", "description"))).alias("fatal"),
    )
    tiers = [F.when(F.sum(F.when(F.col("tier") == t, F.col("n"))) > 0, F.struct(F.lit(t).alias("key"), F.sum(F.when(F.col("tier") == t, F.col("n"))).alias("value"))) for t in sorted((GENUINE, DEGRADED, INFO, DATA_WARNING))]
    states = F.array_sort(F.collect_list(F.when(F.col("of_farm").isNotNull(), F.struct(F.col("of_farm").alias("farm"), F.col("at").alias("at"), F.col("is_ok").alias("is_ok")))))
    all_in = parts.agg(
        F.filter(F.array(*tiers), lambda x: x.isNotNull()).alias("tiers"), states.alias("states"), F.array_sort(F.flatten(F.collect_list("fatal"))).alias("fatal"),
        F.coalesce(F.max_by("lost", F.col("turned")), F.lit(False)).alias("connection_lost"),
    )
    latest = F.filter("states", lambda x, k: (k + 1 == F.size("states")) | (F.get("states", k + 1)["farm"] != x["farm"]))
    one = all_in.select(
        F.lit(connected).alias("connected"), F.map_from_entries("tiers").alias("tier_counts"), F.map_from_entries(F.transform(latest, lambda x: F.struct(x["farm"], x["is_ok"]))).alias("farms"),
        F.transform("fatal", lambda x: F.struct(x["code"].alias("code"), x["description"].alias("description"))).alias("genuine_errors"), "connection_lost",
    )
    n = F.size("genuine_errors")
    codes = F.array_join(F.transform("genuine_errors", lambda g: g["code"].cast("string")), ", ")
    states = F.array_join(F.transform(F.map_entries("farms"), lambda e: F.concat(e["key"], F.when(e["value"], "=OK").otherwise("=BROKEN"))), ", ")
    summary = F.concat_ws(
        "; ",
        F.lit("connected" if connected else "DISCONNECTED"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" genuine error(s) ["), codes, F.lit("]"))).otherwise("no genuine errors"),
        F.when(F.size("farms") > 0, F.concat(F.lit("farms: "), states)),
        F.when(F.col("connection_lost"), "connectivity LOST"),
    )
    return one.select("connected", "tier_counts", "genuine_errors", "farms", "connection_lost", summary.alias("summary"))


def settled(counts: DataFrame, stable: int = 3, by: str | None = None) -> DataFrame:
    """Of a series of row counts (_seq, n), the first place where the count was positive and the same `stable` times in a row, or no row.

    With `by`, a column that names sources, each source's own series: (by, _seq, n).
    """
    from pyspark.sql import Window

    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(-(stable - 1), 0)
    runs = counts.select(*keys, SEQ, "n", F.min("n").over(w).alias("low"), F.max("n").over(w).alias("high"), F.count("*").over(w).alias("k"))
    calm = runs.where((F.col("k") == stable) & (F.col("low") == F.col("high")) & (F.col("n") > 0))
    return calm.groupBy(*keys).agg(F.min(SEQ).alias(SEQ), F.min_by("n", SEQ).alias("n")).where(F.col(SEQ).isNotNull())
