"""Subscriptions to added rows, predicates to watch for, and live current-state views."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.core import SEQ, last_by

if TYPE_CHECKING:
    from ..plans.port import Result, Stream

logger = logging.getLogger(__name__)


def subscribe(result: Result, callback: Callable[[pa.Table], None], *, checkpoint: str | None = None, mode: str = "append") -> Stream:
    """Calls back with each batch of added rows, from the query's own thread; batches without rows are not delivered.

    The table must be a streaming one. With a checkpoint folder a restarted subscription goes on where the last one stopped, else it starts anew.
    A current-state view has no added rows: subscribed in mode "update", it delivers the rows of the keys that changed.
    """
    from ..plans.port import Stream

    if not result.frame.isStreaming:
        raise ValueError("only streaming tables have changes to subscribe to")

    def deliver(batch: DataFrame, _: int) -> None:
        rows = batch.toArrow()
        if rows.num_rows and not stream.cancelled:
            callback(rows)

    writer = result.frame.writeStream.outputMode(mode).foreachBatch(deliver)
    stream = Stream(None)
    stream._query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    return stream


def watch(result: Result, callback: Callable[[pa.Table], None], *, once: bool = False, predicate: str | None = None) -> Stream:
    """Calls back with added rows that fulfil the predicate; with once, for the first such batch only, after which the subscription ends."""
    some = result.port.filter(result, predicate) if predicate else result
    fired = False

    def deliver(rows: pa.Table) -> None:
        nonlocal fired
        if once and fired:
            return
        fired = True
        callback(rows)
        if once:
            stream.cancel()

    stream = subscribe(some, deliver)
    return stream


def live_last_by(df: DataFrame, keys: Sequence[str], seq: str = SEQ) -> DataFrame:
    """The last row of each key of a stream, for output modes update and complete. Its state is one row a key, which grows with the keys alone."""
    return last_by(df, keys, seq)


def asof_against(stream: DataFrame, right: Callable[[], DataFrame], on: Sequence[str], bring: Sequence[str], sink: Callable[[DataFrame, int], None]) -> object:
    """Each batch of a stream joined as of the right table as it then is; sink gets the joined batches."""
    from ..operators.core import asof_join

    return stream.writeStream.foreachBatch(lambda batch, n: sink(asof_join(batch, right(), on, bring), n)).start()


def snapshot_or_empty(query: object, read: Callable[[], DataFrame], schema: object) -> DataFrame:
    """What read() gives, or, where the query that feeds it has failed, an empty table, of which a warning tells. Callers that ask again and again see no rows, not errors."""
    from pyspark.sql import SparkSession

    if (failure := query.exception()) is None:
        return read()
    logger.warning("the source has failed, so it has no rows: %s", str(failure).split("\n", 1)[0])
    return SparkSession.active().createDataFrame([], schema)


def live_pivot(df: DataFrame, by: Sequence[str], key: str, value: str, wanted: Mapping[str, str], driver: str, carry: Mapping[str, str] | None = None, seq: str = SEQ) -> DataFrame:
    """pivot_latest() of a stream, for output modes update and complete; its state is one row for each `by`."""
    from ..operators.core import pivot_latest

    return pivot_latest(df, by, key, value, wanted, driver, carry, seq)


def live_account(overview: DataFrame, only: str | None = None) -> DataFrame:
    """The account table of a stream of account values, a row for each account that has reported NetLiquidation."""
    from ..plans.views import account

    return account(overview, only)


def live_cash_balance(overview: DataFrame, only: str | None = None) -> DataFrame:
    """The cash balances of a stream of account values."""
    from ..plans.views import cash_balance

    return cash_balance(overview, only)


def live_position(positions: DataFrame) -> DataFrame:
    """The positions of a stream of position rows, the last of each account and contract."""
    from ..plans.views import VIEWS, apply_view

    return apply_view(VIEWS["position"], {VIEWS["position"].source: positions})
