"""Account statements in XML: parsing, canonical rows, first-wins deduplication, and a report of what was dropped.

A statement's elements become DataFrames of text attributes with arrival numbers: read on the driver for a single reply, or by Spark's XML source for
folders of archived statements. One set of column mappings serves both. A row that lacks what its table can't do without is dropped
and counted, never filled in.
"""

from __future__ import annotations

import logging
import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatementError
from ..functions.stamps import decimal_text, digits, fingerprint, moment, number
from ..operators.core import SEQ
from ..types import CATALOG

NOT_READY = "1019"
logger = logging.getLogger(__name__)

#: Where each kind of row lies in a statement, and its attributes.
ELEMENTS: dict[str, tuple[str, str, str]] = {
    "trades": ("Trades", "Trade", "accountId symbol assetCategory tradeDate dateTime buySell quantity tradePrice proceeds ibCommission netCash fifoPnlRealized currency ibExecID tradeID conid exchange multiplier orderReference openCloseIndicator ibOrderID orderID levelOfDetail"),
    "cash": ("CashTransactions", "CashTransaction", "accountId symbol type dateTime amount currency description fxRateToBase transactionID"),
    "corporate_actions": ("CorporateActions", "CorporateAction", "symbol type dateTime quantity description"),
    "transfers": ("Transfers", "Transfer", "accountId symbol type dateTime date reportDate settleDate direction quantity transferPrice description positionAmount positionAmountInBase cashTransfer fxRateToBase currency"),
    "nav_changes": ("", "ChangeInNAV", "accountId fromDate toDate startingValue endingValue mtm realized dividends depositsWithdrawals"),
    "fifo": ("", "FIFOPerformanceSummaryUnderlying", "symbol realizedTotal unrealizedTotal totalFifoPnl"),
    "nav": ("", "EquitySummaryByReportDateInBase", "accountId reportDate total cash stock"),
}

#: The section that each kind's rows stand in.
_SECTION = {"nav": "EquitySummaryInBase", "fifo": "FIFOPerformanceSummaryInBase"} | {kind: parent for kind, (parent, _, _) in ELEMENTS.items() if parent or kind == "nav_changes"}

#: Kinds whose rows may stand in a statement without their section.
_BESIDE = ("nav", "fifo")

#: Attributes that are numbers.
NUMERIC = {
    "trades": "quantity tradePrice ibCommission fifoPnlRealized multiplier", "cash": "amount fxRateToBase", "transfers": "quantity transferPrice positionAmount positionAmountInBase cashTransfer fxRateToBase",
    "corporate_actions": "quantity", "nav_changes": "startingValue endingValue mtm realized dividends depositsWithdrawals", "fifo": "realizedTotal unrealizedTotal totalFifoPnl", "nav": "total cash stock",
}

_CONTAINERS = {parent for parent, _, _ in ELEMENTS.values()} | {"EquitySummaryInBase", "FIFOPerformanceSummaryInBase", "ChangeInNAV"}


@dataclass
class Reply:
    """What a statement service answered: ok with rows, in_progress, fail, or error."""

    status: str
    code: str = ""
    message: str = ""
    rows: dict[str, list[dict[str, str]]] = field(default_factory=dict)
    unparsed: list[str] = field(default_factory=list)


def _root(xml: str) -> tuple[ET.Element | None, str]:
    """The document's root, or what is wrong with it."""
    try:
        return ET.fromstring(xml), ""
    except ET.ParseError as e:
        return None, f"not XML: {e}"


def _said(root: ET.Element, tag: str) -> str:
    return (root.findtext(tag) or "").strip()


def send_reply(xml: str) -> dict[str, str]:
    """The answer to a request for a statement: its reference code and address, or why it failed."""
    root, problem = _root(xml)
    if root is None:
        raise StatementError(problem)
    if _said(root, "Status") == "Success":
        return {"reference_code": _said(root, "ReferenceCode"), "url": _said(root, "Url"), "status": "Success"}
    return {"code": _said(root, "ErrorCode"), "message": _said(root, "ErrorMessage"), "status": "Fail"}


def parse(xml: str) -> Reply:
    """A statement reply read whole: every statement in it contributes, in document order."""
    root, problem = _root(xml)
    if root is None:
        return Reply("error", message=problem)
    if root.tag == "FlexStatementResponse":
        code = _said(root, "ErrorCode")
        return Reply("in_progress" if code == NOT_READY else "fail", code, _said(root, "ErrorMessage"))
    statements = list(root.iter("FlexStatement"))
    if not statements:
        return Reply("error", message="the reply holds no statement")
    out = Reply("ok", rows={kind: [] for kind in ELEMENTS})
    for s in statements:
        for kind, (parent, tag, _) in ELEMENTS.items():
            found = s.findall(f".//{parent}/{tag}" if parent else f".//{tag}")
            out.rows[kind] += [dict(e.attrib) for e in (found[:1] if kind == "nav_changes" else found)]
        out.unparsed += [child.tag for child in s if len(child) and child.tag not in _CONTAINERS]
    out.unparsed = list(dict.fromkeys(out.unparsed))
    return out


def parse_or_raise(xml: str) -> Reply:
    reply = parse(xml)
    if reply.status == "in_progress":
        raise StatementError(f"the statement isn't ready yet ({reply.code} {reply.message}); ask again in some seconds")
    if reply.status != "ok":
        raise StatementError(f"the statement can't be read ({reply.status}): {reply.code} {reply.message}".rstrip())
    return reply


def _schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(a, T.StringType()) for a in ELEMENTS[kind][2].split()] + [T.StructField(SEQ, T.LongType())])


def frames(spark: SparkSession, reply: Reply) -> dict[str, DataFrame]:
    """The rows of a parsed reply as DataFrames of text attributes."""
    return {kind: spark.createDataFrame([(*[r.get(a) for a in ELEMENTS[kind][2].split()], i) for i, r in enumerate(reply.rows.get(kind, []))], _schema(kind)) for kind in ELEMENTS}


def _folder_schema() -> T.StructType:
    """A statement with its sections as arrays, since a section may come several times; rows stand in their sections, or, where these are optional, beside them."""
    fields: dict[str, list[T.StructField]] = {}
    for kind, (_, tag, attributes) in ELEMENTS.items():
        rows = T.StructField(tag, T.ArrayType(T.StructType([T.StructField("_" + a, T.StringType()) for a in attributes.split()])))
        fields.setdefault(_SECTION[kind], []).append(rows)
        if kind in _BESIDE:
            fields.setdefault("", []).append(rows)
    sections = [T.StructField(name, T.ArrayType(T.StructType(rows))) for name, rows in fields.items() if name]
    return T.StructType([*sections, *fields.get("", [])])


def read_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The rows of all statements under a path, in one parallel scan with a declared schema: files in the order of their names, a file's rows as they stand in it.

    The parsed statements are kept in memory or on disk, so that all kinds of rows come from the one scan; spark.catalog.clearCache() lets go of them. Of
    ChangeInNAV the first in each statement counts, as in parse(). Files that hold no statement have no rows; folder_replies() tells why.
    """
    raw = spark.read.format("xml").option("rowTag", "FlexStatement").option("attributePrefix", "_").schema(_folder_schema()).load(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    found = {}
    for kind, (_, tag, _) in ELEMENTS.items():
        none = F.array().cast(_kind_array(kind))
        within = [F.coalesce(F.flatten(F.transform(_SECTION[kind], _field_or(tag, none))), none)] if _SECTION[kind] else []
        beside = [F.coalesce(F.col(tag), none)] if kind in _BESIDE or not _SECTION[kind] else []
        found[kind] = F.concat(*within, *beside)
    raw = raw.select("file", "block", "id", *[(F.slice(rows, 1, 1) if kind == "nav_changes" else rows).alias(kind) for kind, rows in found.items()])
    before = Window.partitionBy("file").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
    held = raw.select("file", *ELEMENTS, *[F.coalesce(F.sum(F.size(kind)).over(before), F.lit(0)).alias(f"{kind}_before") for kind in ELEMENTS]).persist()
    names = spark.createDataFrame([(r["file"], k << 34) for k, r in enumerate(held.select("file").distinct().orderBy("file").collect())], "file string, first long")
    out = {}
    for kind, (_, _, attributes) in ELEMENTS.items():
        rows = held.select("file", f"{kind}_before", F.posexplode(kind).alias("at", "row")).join(names, "file")
        out[kind] = rows.select(*[F.col(f"row._{a}").alias(a) for a in attributes.split()], (F.col("first") + F.col(f"{kind}_before") + F.col("at")).alias(SEQ))
    return out


def _field_or(name: str, other: Column) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x[name], other)


def _kind_array(kind: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("_" + a, T.StringType()) for a in ELEMENTS[kind][2].split()]))


def folder_replies(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, code, message) of every file under a path: ok where it holds a statement, in_progress or fail for a service's refusals, else error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    refused, code = F.col("value").rlike(r"<FlexStatementResponse[\s>]"), F.trim(F.regexp_extract("value", r"<ErrorCode>([^<]*)</ErrorCode>", 1))
    status = F.when(refused, F.when(code == NOT_READY, "in_progress").otherwise("fail")).when(F.col("value").rlike(r"<FlexStatement[\s/>]"), "ok").otherwise("error")
    return raw.select("file", status.alias("status"), F.when(refused, code).otherwise("").alias("code"), F.when(refused, F.trim(F.regexp_extract("value", r"<ErrorMessage>([^<]*)</ErrorMessage>", 1))).otherwise("").alias("message"))


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def executions(trades: DataFrame) -> DataFrame:
    """Canonical executions with _seq and `dropped`, the reason why a row can't be used, else null."""
    level = F.upper(F.trim(F.coalesce("levelOfDetail", F.lit(""))))
    rows = trades.where(level.isin("", "EXECUTION"))
    stamp = F.coalesce(_text("dateTime"), _text("tradeDate"))
    qty, price, sym = number(F.col("quantity")), number(F.col("tradePrice")), _text("symbol")
    made = fingerprint("synx-", F.col("accountId"), F.col("symbol"), stamp, decimal_text(qty), decimal_text(price))
    found = rows.select(
        F.coalesce(_text("ibExecID"), _text("tradeID"), made).alias("ExecId"), moment(stamp).alias("Timestamp"), _text("accountId").alias("Account"), digits(F.col("conid")).alias("ConId"),
            digits(F.coalesce(_text("ibOrderID"), _text("orderID"))).alias("OrderId"), F.col("orderReference").alias("OrderRef"),
        sym.alias("Sym"), _text("assetCategory").alias("SecType"), F.coalesce("buySell", F.lit("")).alias("Side"), F.abs(qty).alias("Qty"), price.alias("Price"),
            F.coalesce(number(F.col("multiplier")), F.lit(1.0)).alias("Multiplier"), _text("exchange").alias("Venue"), F.lit(None).cast("string").alias("Liquidity"),
        F.col("currency").alias("Currency"), F.col("openCloseIndicator").alias("OpenClose"), number(F.col("ibCommission")).alias("Commission"), number(F.col("fifoPnlRealized")).alias("RealizedPnl"), SEQ,
    )
    return found.withColumn("dropped", F.when(F.col("Timestamp").isNull(), "timestamp").when(F.col("Sym").isNull() | F.col("Price").isNull() | F.col("Qty").isNull(), "symbol, price or quantity"))


def _cash_id() -> Column:
    stamp = F.concat(F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros("Timestamp") % 1000000 != 0, F.date_format("Timestamp", ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    return fingerprint("syn-", F.col("Account"), stamp, F.col("Type"), F.col("Sym"), decimal_text(F.col("Amount")), F.col("Currency"))


def cash(transactions: DataFrame) -> DataFrame:
    """Canonical cash movements with _seq and `dropped`; amounts and currencies stay local."""
    rows = transactions.select(_text("transactionID").alias("TxnId"), _text("accountId").alias("Account"), moment(F.col("dateTime")).alias("Timestamp"), F.coalesce("type", F.lit("")).alias("Type"),
        _text("symbol").alias("Sym"), number(F.col("amount")).alias("Amount"), F.col("currency").alias("Currency"), number(F.col("fxRateToBase")).alias("FxRateToBase"), SEQ)
    return rows.withColumn("TxnId", F.coalesce("TxnId", _cash_id())).withColumn("dropped", F.when(F.col("Amount").isNull(), "amount").when(F.col("Timestamp").isNull(), "timestamp"))


def transfers(rows: DataFrame) -> DataFrame:
    """Transfers in kind as cash movements with _seq and `dropped`.

    Worth, in the row's own currency: the base amount by a positive rate; without one the position amount, else the base amount as it is; the
    position amount; quantity by price; the cash transferred. OUT counts negative, anything else positive.
    """
    base, own, fx = number(F.col("positionAmountInBase")), number(F.col("positionAmount")), number(F.col("fxRateToBase"))
    worth = F.when(base.isNotNull(), F.when(fx > 0, F.abs(base) / F.when(fx > 0, fx)).otherwise(F.abs(F.coalesce(own, base)))).otherwise(F.coalesce(F.abs(own), F.abs(number(F.col("quantity")) * number(F.col("transferPrice"))), F.abs(number(F.col("cashTransfer")))))
    out = F.upper(F.trim(F.coalesce("direction", F.lit("IN")))) == "OUT"
    stamp = F.coalesce(_text("dateTime"), _text("date"), _text("reportDate"), _text("settleDate"))
    found = rows.select(_text("accountId").alias("Account"), moment(stamp).alias("Timestamp"), F.lit("Transfer").alias("Type"), _text("symbol").alias("Sym"), F.when(out, -worth).otherwise(worth).alias("Amount"), _text("currency").alias("Currency"), fx.alias("FxRateToBase"), SEQ)
    return found.withColumn("TxnId", _cash_id()).withColumn("dropped", F.when(F.col("Amount").isNull(), "amount").when(F.col("Timestamp").isNull(), "timestamp"))


def nav(rows: DataFrame) -> DataFrame:
    found = rows.select(_text("accountId").alias("Account"), moment(F.col("reportDate")).alias("Timestamp"), *[number(F.col(c)).alias(c.title()) for c in ("total", "cash", "stock")], SEQ)
    return found.withColumn("dropped", F.when(F.col("Total").isNull(), "total").when(F.col("Timestamp").isNull(), "timestamp"))


def corporate_actions(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """(kind, symbol, type, date_time, quantity, description, _seq): corporate actions, then transfers."""
    a = rows.select(F.lit("corporate_action").alias("kind"), "symbol", "type", F.col("dateTime").alias("date_time"), number(F.col("quantity")).alias("quantity"), "description", SEQ)
    t = moved.select(F.lit("transfer").alias("kind"), "symbol", "type", F.coalesce(_text("dateTime"), _text("date"), _text("reportDate"), _text("settleDate")).alias("date_time"), number(F.col("quantity")).alias("quantity"), "description", SEQ)
    return a.unionByName(t)


def nav_changes(rows: DataFrame) -> DataFrame:
    return rows.select("accountId", "fromDate", "toDate", *[number(F.col(c)).alias(c) for c in ("startingValue", "endingValue", "mtm", "realized", "dividends", "depositsWithdrawals")], SEQ)


def fifo(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", *[number(F.col(c)).alias(c) for c in ("realizedTotal", "unrealizedTotal", "totalFifoPnl")], SEQ)


def first_of(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in document order, and the repeats."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(SEQ)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


@dataclass
class Statement:
    """Canonical tables of statements, and what became of their rows."""

    tables: dict[str, DataFrame]
    report: DataFrame
    corporate_actions: DataFrame
    nav_changes: DataFrame
    fifo: DataFrame


_KEYS = {"execution": ["ExecId"], "cash": ["TxnId"], "nav": ["Account", "Timestamp"]}


def canonicalize(sections: Mapping[str, DataFrame]) -> Statement:
    """Canonical executions, cash with transfers after it, and NAV, first occurrences only; and a report (table, outcome, rows).

    Outcomes are kept, dropped: <what is missing>, repeated, and repeated synthetic for repeats of an identity that was made up from content.
    """
    moved = transfers(sections["transfers"]).withColumn(SEQ, F.col(SEQ) + F.lit(1 << 60))
    mapped = {"execution": executions(sections["trades"]), "cash": cash(sections["cash"]).unionByName(moved), "nav": nav(sections["nav"])}
    tables, reports = {}, []
    for name, rows in mapped.items():
        first, again = first_of(rows.where("dropped IS NULL"), _KEYS[name])
        tables[name] = CATALOG[name].project(first.orderBy(SEQ)) if name == "nav" else CATALOG[name].project(first)
        made = F.col(_KEYS[name][0]).rlike("^synx?-") if name != "nav" else F.lit(False)
        reports += [
            rows.where("dropped IS NOT NULL").groupBy(F.concat(F.lit("dropped: "), F.col("dropped")).alias("outcome")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "outcome", "rows"),
            again.groupBy(F.when(made, "repeated synthetic").otherwise("repeated").alias("outcome")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "outcome", "rows"),
            first.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit("kept").alias("outcome"), "rows"),
        ]
    report = reports[0]
    for x in reports[1:]:
        report = report.unionByName(x)
    return Statement(tables, report, corporate_actions(sections["corporate_actions"], sections["transfers"]), nav_changes(sections["nav_changes"]), fifo(sections["fifo"]))


def source_text(source: str | Path) -> str:
    """XML as it is, or the text of the file it names."""
    return source if isinstance(source, str) and source.lstrip().startswith("<") else Path(source).read_bytes().decode()


def unreadable(sections: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, attribute, rows, example): numbers that are there but can't be read, and so count as absent."""
    parts = []
    for kind, names in NUMERIC.items():
        for name in names.split():
            bad = sections[kind].where((F.trim(name) != "") & number(F.col(name)).isNull())
            parts.append(bad.agg(F.count("*").alias("rows"), F.min(name).alias("example")).select(F.lit(kind).alias("kind"), F.lit(name).alias("attribute"), "rows", "example"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where("rows > 0")


def load(spark: SparkSession, source: str | Path) -> Statement:
    """The canonical tables of one statement, given as XML or as a path; StatementError if it can't be read. Numbers that can't be read and sections that aren't are warned of."""
    reply = parse_or_raise(source_text(source))
    for kind, names in NUMERIC.items():
        for name in names.split():
            bad = [r[name] for r in reply.rows.get(kind, []) if r.get(name, "").strip() and not _is_number(r[name])]
            if bad:
                logger.warning("%d values of %s in %s are no numbers and count as absent, the first is %r", len(bad), name, kind, bad[0])
    if reply.unparsed:
        logger.warning("sections that are not read: %s", ", ".join(reply.unparsed))
    return canonicalize(frames(spark, reply))


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def load_port(spark: SparkSession, source: str | Path):
    """A port over a statement: execution, cash, and nav if the statement has equity summaries."""
    from ..plans.port import connect

    reply = parse_or_raise(source_text(source))
    tables = canonicalize(frames(spark, reply)).tables
    return connect({name: df for name, df in tables.items() if name != "nav" or reply.rows["nav"]})
