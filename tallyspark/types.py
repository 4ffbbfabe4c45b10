"""Logical types, table schemas, and the catalogue of canonical tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaMismatch


class DType(Enum):
    """The five logical types. Spark keeps time stamps to the microsecond; Arrow gets them as nanoseconds in UTC."""

    BOOL = "BOOL"
    FLOAT64 = "FLOAT64"
    INT64 = "INT64"
    STRING = "STRING"
    TIMESTAMP_NS = "TIMESTAMP_NS"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def arrow(self) -> pa.DataType:
        return _ARROW[self]

    @classmethod
    def of(cls, kind: T.DataType) -> DType:
        """The logical type of a Spark type; narrow numbers widen, what has no counterpart is a STRING."""
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return cls.INT64
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return cls.FLOAT64
        if isinstance(kind, T.BooleanType):
            return cls.BOOL
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return cls.TIMESTAMP_NS
        return cls.STRING


_SPARK = {DType.STRING: T.StringType(), DType.INT64: T.LongType(), DType.FLOAT64: T.DoubleType(), DType.BOOL: T.BooleanType(), DType.TIMESTAMP_NS: T.TimestampType()}
_ARROW = {DType.STRING: pa.string(), DType.INT64: pa.int64(), DType.FLOAT64: pa.float64(), DType.BOOL: pa.bool_(), DType.TIMESTAMP_NS: pa.timestamp("ns", tz="UTC")}


@dataclass(frozen=True)
class Field:
    name: str
    dtype: DType
    nullable: bool = True


@dataclass(frozen=True)
class Schema:
    """A table's name and ordered fields; settled tables hold statement data that no longer changes."""

    name: str
    fields: tuple[Field, ...]
    settled: bool = False

    def __post_init__(self) -> None:
        names = self.names
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: a column name occurs twice")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def dtype(self, name: str) -> DType | None:
        return next((f.dtype for f in self.fields if f.name == name), None)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dtype.spark, f.nullable) for f in self.fields])

    @property
    def arrow(self) -> pa.Schema:
        return pa.schema([pa.field(f.name, f.dtype.arrow, f.nullable) for f in self.fields])

    def validate(self, df: DataFrame) -> None:
        """Raises SchemaMismatch where a declared column is missing or of another logical type. Order, further columns and nullability are free."""
        have = {f.name: f.dataType for f in df.schema}
        for f in self.fields:
            if f.name not in have:
                raise SchemaMismatch(f"{self.name}: column {f.name} is missing")
            if DType.of(have[f.name]) is not f.dtype:
                raise SchemaMismatch(f"{self.name}: column {f.name} is {have[f.name].simpleString()}, not {f.dtype.value}")

    def project(self, df: DataFrame) -> DataFrame:
        """The declared columns of df in order, absent ones as nulls of their types."""
        have = set(df.columns)
        return df.select(*[column(f.name).cast(f.dtype.spark).alias(f.name) if f.name in have else F.lit(None).cast(f.dtype.spark).alias(f.name) for f in self.fields])


def column(name: str) -> SparkColumn:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema_of(df: DataFrame, name: str = "<derived>") -> Schema:
    """The logical schema of any DataFrame, all of it nullable."""
    return Schema(name, tuple(Field(f.name, DType.of(f.dataType)) for f in df.schema))


_KINDS = {"s": DType.STRING, "i": DType.INT64, "f": DType.FLOAT64, "b": DType.BOOL, "t": DType.TIMESTAMP_NS}


def _table(name: str, spec: str, settled: bool = False) -> Schema:
    fields = []
    for word in spec.split():
        column_name, _, kind = word.partition(":")
        fields.append(Field(column_name, _KINDS[kind[0]], not kind.endswith("*")))
    return Schema(name, tuple(fields), settled)


#: The canonical tables by name; * marks columns that are never null.
CATALOG: dict[str, Schema] = {
    table.name: table
    for table in (
        _table("account", "Account:s* Timestamp:t* NetLiquidation:f BuyingPower:f MaintMargin:f GrossPositionValue:f Currency:s TotalCashValue:f"),
        _table("account_pnl", "Account:s* Timestamp:t DailyPnl:f UnrealizedPnl:f RealizedPnl:f"),
        _table("position", "Account:s* ConId:i* Sym:s* SecType:s Qty:f* AvgCost:f Right:s Strike:f LastTradeDateOrContractMonth:s LocalSymbol:s Multiplier:f Currency:s Exchange:s MarketPrice:f MarketValue:f UnrealizedPnl:f"),
        _table("position_pnl", "Account:s* ConId:i* Sym:s DailyPnl:f UnrealizedPnl:f RealizedPnl:f MarketValue:f"),
        _table("order", "OrderId:i* PermId:i Account:s Sym:s* Side:s* Qty:f* FilledQty:f LimitPrice:f Status:s Timestamp:t"),
        _table("execution", "ExecId:s* Timestamp:t* Account:s ConId:i OrderId:i OrderRef:s Sym:s* SecType:s Side:s* Qty:f* Price:f* Multiplier:f Venue:s Liquidity:s Currency:s OpenClose:s Commission:f RealizedPnl:f"),
        _table("cash", "TxnId:s Account:s Timestamp:t* Type:s* Sym:s Amount:f* Currency:s FxRateToBase:f", settled=True),
        _table("cash_balance", "Account:s* Currency:s* CashBalance:f NetLiquidation:f ExchangeRate:f"),
        _table("nav", "Account:s Timestamp:t* Total:f* Cash:f Stock:f", settled=True),
        _table("definition", "ConId:i* Sym:s* SecType:s Exchange:s Currency:s Multiplier:f Right:s Strike:f LastTradeDateOrContractMonth:s LocalSymbol:s"),
        _table("quote", "Sym:s* Timestamp:t* Bid:f Ask:f BidSize:f AskSize:f Last:f"),
        _table("price_tick", "ConId:i* Sym:s TickType:s* Price:f Timestamp:t*"),
        _table("bar", "Sym:s* Timestamp:t* Open:f High:f Low:f Close:f Volume:f"),
        _table("trade", "Sym:s* Timestamp:t* Price:f* Size:f"),
        _table("book", "Sym:s* Timestamp:t* Side:s* Level:i* Price:f Size:f"),
        _table("commission", "ExecId:s* Timestamp:t* Commission:f Currency:s RealizedPnl:f Yield:f YieldRedemptionDate:s"),
        _table("news", "Timestamp:t* Sym:s ConId:i ProviderCode:s ProviderName:s ArticleId:s Headline:s*"),
        _table("news_provider", "Code:s* Name:s*"),
        _table("errors", "Timestamp:t* ReqId:i Code:i* Message:s* Detail:s Note:s Severity:s* Sym:s ConId:i"),
    )
}
