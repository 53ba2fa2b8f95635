"""A streaming sink: each micro-batch is one commit, taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from keyfold.operators.table import KVTable


def table_sink(table: KVTable, stream: str, order_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: applies (key, op, value) rows.

    The batch number is committed with the rows, so a batch that a restarted query sends
    again is skipped. ``stream`` has to stay the same over restarts.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.apply_all(batch, order_by, (stream, number))

    return write
